"""Main-text extraction with a site style tree.

The distinct pages of a host are merged into one style tree, keyed by the path of element styles (tag, class, id, role) from the
root. For each path two entropies are taken over the m pages that have it: of its contents (content that is the same on
all pages carries no importance, content of one page only has importance 1) and of its presentation (the sequences of
child styles). Their weighted sum is the path's importance; paths that enough pages share and whose importance is low are
noise, and their text is removed from every page of the host.

Repetition cannot tell what differs from page to page, such as reader comments and adverts, and a host of one page repeats
nothing. There HTML itself has to say it: elements whose tag, role or class name says menu, header, footer, sidebar, notice,
advert, teaser, form or reader comment are removed as such. A class name says so if one of its words does and the others
only say where or what kind of box ("cookie-banner", "site-header"); with any other word ("legal-guide") it is a subject.
The text of the page's articles and of its main element is what remains if it has any; noise of the style tree is removed
there too, and on pages without.

Blocks are runs of text between block-level tags; in a block, character references are decoded, white space becomes one
space; blocks are joined by an empty line.

Defined results: null and empty pages give an empty text; repeated pages give repeated rows and count once in the tree;
pages without a host (null urls too) are judged by their tags alone; truncated pages are read up to their end, and a tag,
comment or script that is not closed ends there; of attributes that repeat the first counts; very long pages are read
whole, in time proportional to their length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Paths of a host below this importance, on so many pages at least, are noise.
IMPORTANCE, MIN_PAGES, GAMMA = 0.35, 3, 0.9
#: Rows of the noise table up to which it is broadcast; beyond, it is joined by host.
BROADCAST_ROWS = 200_000

#: A comment, a tag with its attributes, or other markup. Quotes count after an equals sign only; elsewhere they are plain.
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>|<[!?/][^>]*>", re.S)
OPENED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu object canvas audio video search label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "copyright discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser teasers toolbar topbar widget widgets".split()
)
#: Words of class names that say where something is or what kind of box, not what it is about.
PLACES = frozenset(
    "area article articles bar block body bottom box boxes button buttons center col column container count desktop first fixed form global group "
    "heading icon icons inline inner item items js label last left link links list main mobile more outer page panel post posts primary reader right row "
    "secondary section site slot sticky text thread title top unit user wrap wrapper".split()
)
#: What a start tag closes, up to the elements that hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("html body table td th caption button article section div main li dd blockquote form aside nav footer header".split())


class _Open:
    __slots__ = ("article", "dropped", "kids", "main", "path", "tag")

    def __init__(self, tag, path, dropped, article, main):
        self.tag, self.path, self.dropped, self.article, self.main = tag, path, dropped, article, main
        self.kids: list[int] = []


def _noise_words(token: str) -> set[str]:
    """What a class name or id says of noise: its words for it, if the others only say where."""
    words = {n.lower() for n in NAME.findall(token) if not n.isdigit()}
    found = NOISE_NAMES & words
    return found if words <= NOISE_NAMES | PLACES else set()


def _is_noise(tag: str, tokens: list[str], role: str, attributes: dict[str, str], article: int) -> bool:
    if tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if tag == "header" and not article:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "main"):
        return False
    found = set().union(*map(_noise_words, tokens)) if tokens else set()
    return bool(found) and not (article and found <= {"header", "byline", "banner"})


def parse(page: str):
    """(chunks, styles): chunks are (block, path, dropped, article, main, text); styles maps paths to child styles."""
    chunks: list[tuple] = []
    styles: dict[int, list[int]] = defaultdict(list)
    stack = [_Open("", 0, False, 0, 0)]
    block = at = articles = mains = 0
    end = len(page)
    last = page.rfind(">")  # behind it no tag ends: one that begins there is cut off
    cut = OPENED.search(page, last + 1)
    end = cut.start() if cut else end
    cache: dict[tuple, tuple] = {}

    def close(depth):
        nonlocal block
        while len(stack) > depth:
            gone = stack.pop()
            if gone.kids:
                styles[gone.path].extend(gone.kids)
            if gone.tag in BLOCK:
                block += 1

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if stop > at:
            top = stack[-1]
            chunks.append((block, top.path, top.dropped, top.article, top.main, page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                chunks.append((block, stack[-1].path, True, 0, 0, " "))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in SCOPE and tag not in BLOCK:
                    break
            else:
                block += tag in BLOCK
            continue
        if tag in RAW:
            low = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = low.end() if low else end
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "hr"):
                top = stack[-1]
                chunks.append((block, top.path, top.dropped, top.article, top.main, " "))
                block += tag == "hr"
            continue
        if tag in BLOCK:
            block += 1
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in SCOPE:
                    break
            if tag in CLOSES:
                ends, holders = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in holders:
                        break
                    if stack[depth].tag in ends:
                        close(depth)
        rest = m[3]
        top = stack[-1]
        key = (tag, rest) if len(rest) < 80 else None
        got = cache.get(key) if key else None
        if got is None:
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in reversed(ATTRIBUTE.findall(rest))} if rest else {}
            names = [*attributes.get("class", "").split(), attributes.get("id", "")]
            role = attributes.get("role", "").strip().lower()
            style = zlib.crc32(f"{tag} {attributes.get('class', '')} {'' if any(c.isdigit() for c in attributes.get('id', '')) else attributes.get('id', '')} {role}".encode())
            got = attributes, names, role, style
            if key:
                cache[key] = got
        attributes, names, role, style = got
        top.kids.append(style)
        article, main = top.article, top.main
        dropped = top.dropped or _is_noise(tag, names, role, attributes, article)
        if not dropped:
            if tag == "article" and not article:
                articles += 1
                article = articles
            if (tag == "main" or role == "main") and not main:
                mains += 1
                main = mains
        path = zlib.crc32(style.to_bytes(4, "little"), top.path)
        stack.append(_Open(tag, path, dropped, article, main))
        if rest.endswith("/") and tag not in BLOCK:
            close(len(stack) - 1)
    close(1)
    return chunks, styles


def _blocks(chunks) -> list[str]:
    texts: dict[int, list[str]] = {}
    for c in chunks:
        texts.setdefault(c[0], []).append(c[-1])
    out = (" ".join(html.unescape("".join(t)).split()) for t in texts.values())
    return [t for t in out if t]


def extract(page: str | None, noise: frozenset | set = frozenset()) -> str:
    """The main text of a page; noise: paths of its host's style tree that are of low importance."""
    chunks, _ = parse(page or "")
    inside = any(c[-1].strip() for c in chunks if (c[3] or c[4]) and not c[2])
    return "\n\n".join(_blocks([c for c in chunks if not c[2] and c[1] not in noise and (c[3] or c[4] or not inside)]))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def _host_key(url: str | None) -> int | None:
    host = host_of(url)
    return np.uint64(xxhash.xxh64_intdigest(host.encode(), 1)).astype(np.int64).item() if host else None


def _tree_rows(batches):
    """(url, html) -> one row for each path and kind of a page: (host, path, kind, feature, page)."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            host = _host_key(url)
            if host is None:
                continue
            whole = page.as_py() or ""
            digest = np.uint64(xxhash.xxh64_intdigest(whole.encode(), 2)).astype(np.int64).item()
            chunks, styles = parse(whole)
            texts: dict[int, list[str]] = defaultdict(list)
            for c in chunks:
                if not c[-1].isspace():
                    texts[c[1]].append(" ".join(c[-1].split()))
            rows = [(p, 0, "\0".join(t).encode()) for p, t in texts.items()] + [(p, 1, np.array(k, np.uint32).tobytes()) for p, k in styles.items()]
            for path, kind, feature in rows:
                for x, v in zip(out, (host, path, kind, np.uint64(xxhash.xxh64_intdigest(feature)).astype(np.int64).item(), digest)):
                    x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["host", "path", "kind", "feature", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the distinct pages of each host; hosts and paths by their hashes.

    Counted by (host, path, kind, feature) with partial aggregation, so a host with a third of all pages is no hot group.
    """
    rows = pages.select("url", "html").mapInArrow(_tree_rows, "host long, path long, kind int, feature long, page long").distinct()
    counts = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"))
    # content: mean over pages of 1 - log_m(n); presentation: entropy in base m, which is 1 - s / (m log m) as well
    share = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    wide = sums.withColumn("x", share).groupBy("host", "path").agg(
        F.max("m").alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("x"))).alias("content"), F.max(F.when(F.col("kind") == 1, F.col("x"))).alias("form")
    )
    both = F.lit(GAMMA) * F.col("content") + F.lit(1 - GAMMA) * F.coalesce("form", F.lit(0.0))
    return wide.where("content is not null").select("host", "path", "pages", both.alias("importance"))


def _extract_rows(noise: dict[int, set] | None):
    def run(batches):
        for batch in batches:
            lists = batch.column("__noise").to_pylist() if noise is None else None
            texts = []
            for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html"))):
                own = set(lists[i] or ()) if noise is None else noise.get(_host_key(url), frozenset())  # none without a host
                texts.append(extract(page.as_py(), own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, importance: float = IMPORTANCE, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, n_chars in code points."""
    spark = pages.sparkSession
    arrow_batches(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    tree = style_tree(own)
    noise = tree.where((F.col("pages") >= min_pages) & (F.col("importance") < importance)).select("host", "path")
    rows = noise.limit(broadcast_rows + 1).toArrow()
    schema = "page_id long, url string, text string, n_chars long"
    if rows.num_rows <= broadcast_rows:
        table: dict[int, set] = defaultdict(set)
        for host, path in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist()):
            table[host].add(path)
        return own.mapInArrow(_extract_rows(dict(table)), schema)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_host_key(u) for u in batch.column("url").to_pylist()], pa.int64())], [*batch.schema.names, "__host"])

    by_host = noise.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__noise"))  # paths of one host
    both = own.mapInArrow(keyed, "page_id long, url string, html string, __host long").join(by_host, "__host", "left")
    return both.select("page_id", "url", "html", "__noise").mapInArrow(_extract_rows(None), schema)
