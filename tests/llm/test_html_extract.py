import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from lakeseek.llm import html_extract as H

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>a</p><p>b<b>c</b> d<br>e</p>": "a\n\nbc d e",
    "<article><h1>T &amp; U</h1><p><b>one<br><p>two &lt;x&gt; &copy; &#233;&nbsp;z</article><footer>f</footer>": "T & U\n\none\n\ntwo <x> © é z",
    "<nav><ul><li><a href=x>m</a></ul></nav><div class=ad>buy</div><article><p>text</p></article><aside>s</aside>": "text",
    "<header><h1>Site</h1></header><main><p>a<p>b</main><div id='cookie-banner'>ok?</div>": "a\n\nb",
    "<article><header><h1>Title</h1></header><p>x</p><section class='comments'><article class='comment'><p>nice long comment indeed, longer than all</p></article></section></article>": "Title\n\nx",
    "<body class='has-sidebar'><div class='layout with-sidebar'><article>in</article></div><div class='sidebar'>out</div></body>": "in",
    "<script>var t='<p>no</p>';</script><style>p{}</style><p>yes</p><noscript><p>no</p></noscript><template><p>no</p></template>": "yes",
    "<article><p>cut &am": "cut &am",
    "<article><p>cut &amp": "cut &",
    "<article><p>cut <foo": "cut",
    "<article><p>cut <!-- never closed": "cut",
    "<article><p>cut </p><script>var x": "cut",
    "<article><p>a < b and c > d</p></article>": "a < b and c > d",
    "<article><ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>": "one\n\ntwo\n\nin\n\nc1\n\nc2\n\nc3",
    "<article><form><p>email</p><input></form><p hidden>h</p><p style='display: none'>n</p><p aria-hidden='true'>n</p><p>v</p></article>": "v",
    "<ARTICLE CLASS='Post'><P>Upper</P></ARTICLE>": "Upper",
    "foo</p>bar": "foo\n\nbar",
    "<article class=teaser><p>short</p></article><article><p>the long one of the page</p></article>": "the long one of the page",
    "<a title='x > y' href=\"q\">link</a><p>Body</p>": "link\n\nBody",
    "<p data-x=it's>a</p><p title=\"it's\" x='\"'>b</p><p a=\"x>y\" class = 'ad'>c</p><p \"'>d</p><a href=q?a=\"b>e</a>": "a\n\nb\n\nd\n\ne",
    "<div class='legal-guide'><p>law</p></div><div class='social-science'><p>people</p></div><div data-class='ad' title='a class=ad'>kept</div>": "law\n\npeople\n\nkept",
    "<div class='x cookieNotice'>ok?</div><div class='social-links'>f</div><div id='site_header'>h</div><div class='related-posts'>r</div><p class=a class=ad>t</p>": "t",
    "<article><div class='post-header'><h1>Title</h1></div><p>x</p><div class='ad-slot-2'>buy</div></article>": "Title\n\nx",
}


@pytest.mark.parametrize("page,text", CASES.items())
def test_pages(page, text):
    assert H.extract(page) == text


def test_null_and_long_pages():
    assert H.extract(None) == ""
    assert H.extract("<a" * 200_000) == "" and H.extract("<" * 100_000) == "<" * 100_000
    assert H.extract("<p>" + "w " * 300_000) == ("w " * 300_000).strip()
    assert H.extract("<div>" * 5000 + "deep") == "deep"


def test_style_tree_finds_what_a_host_repeats(spark):
    row = lambda i, host: (i, f"http://{host}/p/{i}", f"<div class='box{'' if host == 'a.org' else 'x'}'>Welcome to our site, the best.</div><div class='body'><p>Article number {i} says this and that {i * 7}.</p></div>")
    pages = spark.createDataFrame([row(i, "a.org") for i in range(12)] + [row(50, "b.org"), (60, None, None), (60, None, None)], "page_id long, url string, html string")
    for most in (1000, 0):  # broadcast, or joined by host
        got = {}
        for r in H.extract_pages(pages.withColumn("text", pages.url), broadcast_rows=most).collect():
            got.setdefault(r.page_id, []).append((r.text, r.n_chars))
        assert got[3] == [("Article number 3 says this and that 21.", 39)]
        assert got[50] == [("Welcome to our site, the best.\n\nArticle number 50 says this and that 350.", 73)]
        assert got[60] == [("", 0), ("", 0)]
    tree = {(r.pages, round(r.importance, 3)) for r in H.style_tree(pages).collect()}
    assert (12, 0.0) in tree and any(n == 12 and x > 0.85 for n, x in tree)
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_hosts():
    assert [H.host_of(u) for u in ("http://A.org:80/x", "https://u:p@b.org/x@y", "//c.org?q", "no host", None)] == ["a.org", "b.org", "c.org", "", ""]


def test_low_importance_inside_articles(spark):
    html = lambda i: f"<main><article><p>Story {i} of {i * 7}.</p><div class='box'>Join our list today.</div></article></main>"
    pages = spark.createDataFrame([(i, "http://a.org/", html(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_pages(pages).collect()} == {f"Story {i} of {i * 7}." for i in range(8)}


def test_copies_count_once(spark):
    page = lambda i: f"<div class=a><p>Text of page {i}, {i * 7}.</p></div>"
    data = [(i, "http://copies.org/", page(0)) for i in range(5)] + [(10 + i, "http://mixed.org/", page(0 if i < 54 else i)) for i in range(60)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[0] == got[10] == "Text of page 0, 0." and all(got[10 + i] == f"Text of page {i}, {i * 7}." for i in range(54, 60))


def test_whole_main_and_reference_lists():
    page = "<main><h1>Title</h1><p>Lead</p><article><p>part one</p></article><article><p>part two, longer</p></article><p>end</p></main><p>out</p>"
    assert H.extract(page) == "Title\n\nLead\n\npart one\n\npart two, longer\n\nend"
    assert H.extract("<article>post 1</article><div>x</div><article>post 2</article>") == "post 1\n\npost 2"
    assert H.extract("<p>Text</p><ul><li><a href=x>A reference</a></ul>") == "Text\n\nA reference"


class Tree(HTMLParser):
    """A plain reader of well-formed pages: (path of styles, text) in order, and the child styles of each path."""

    def __init__(self, page):
        super().__init__()
        self.at, self.texts, self.kids, self.texts_in_order = (), defaultdict(list), defaultdict(list), []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        style = (tag, dict(attrs).get("class", ""))
        self.kids[self.at].append(style)
        self.at += (style,)

    def handle_endtag(self, tag):
        self.at = self.at[:-1]

    def handle_data(self, data):
        if data.strip():
            self.texts[self.at].append(" ".join(data.split()))
            self.texts_in_order.append((self.at, " ".join(data.split())))


def entropy(features):
    m = len(features)
    return 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in Counter(features).values())


def plain_noise(pages):
    """Paths of low importance of one host, by the entropies as they are defined."""
    trees = [Tree(p) for p in set(pages)]
    noise = set()
    for path in {p for t in trees for p in t.texts}:
        content = [tuple(t.texts[path]) for t in trees if path in t.texts]
        form = [tuple(t.kids[path]) for t in trees if t.kids.get(path)]
        importance = H.GAMMA * entropy(content) + (1 - H.GAMMA) * (entropy(form) if form else 0)
        if len(content) >= H.MIN_PAGES and max(len(content), len(form)) >= H.MIN_PAGES and importance < H.IMPORTANCE:
            noise.add(path)
    return noise


def plain_text(page, noise):
    kept = [(p, t) for p, t in Tree(page).texts_in_order if p not in noise]
    return "\n\n".join(t for p, t in kept if any(s[0] in ("article", "main") for s in p)) if "<article" in page else "\n\n".join(t for _, t in kept)


@pytest.mark.parametrize("most", [1000, 0])
def test_against_a_plain_style_tree(spark, most):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eta zeta theta iota".split()) + str(rng.randrange(999)) for _ in range(n))
    rows, hosts = [], defaultdict(list)
    for h in range(6):
        fixed, few = words(5), [words(3) for _ in range(2)]
        for i in range([1, 2, 3, 8, 20, 40][h]):
            box = lambda c, t: f"<div class='{c}'><p>{t}</p></div>"
            parts = [box("w1", fixed), box("w2", rng.choice(few)), box("w3", words(2)), *(box("w4", words(9)) for _ in range(rng.randrange(3))), box("w5", fixed if rng.random() < 0.5 else words(4))]
            rng.shuffle(parts)
            text = "".join(parts)
            page = [f"<body><article>{text}</article>{box('w6', 'beside')}</body>", f"<body>{text}</body>"][h % 2]
            for _ in range(rng.choice([1, 1, 3])):  # copies
                rows.append((len(rows), f"http://h{h}.org/{i}", page))
                hosts[h].append(page)
    noise = {h: plain_noise(p) for h, p in hosts.items()}
    assert sum(map(len, noise.values())) > 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_pages(df, broadcast_rows=most).collect()}
    assert got == {i: plain_text(page, noise[int(url[8])]) for i, url, page in rows}
    assert any(got[i] != H.extract(page) for i, _, page in rows if "<article" in page)


def test_pages_without_a_host_are_judged_alone(spark):
    rows = [(i, [None, "", "no host"][i % 3], f"<div class=a><p>Same</p></div><p>{i}</p>") for i in range(9)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Same\n\n{i}" for i in range(9)}


def test_copies_of_a_page_change_nothing(spark):
    page = "<div class=a><p>Text</p></div><div class=b>More</div>"
    one = spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_pages(one).collect()} == {r.text for r in H.extract_pages(one.union(one).union(one)).collect()} == {"Text\n\nMore"}
