"""Exact substring deduplication by column-wise construction of a multi-document suffix order.

Every byte of a string of `width` bytes that starts anywhere else in the collection, the same document included, is
removed. The order of suffixes is built column by column for many fragments at once: each round inserts one symbol per
fragment, re-sorts the collection's Burrows-Wheeler column stably by that symbol, and updates the common prefixes of
neighbours, so that after the round all suffixes from that column on are in order and a start is repeated if a neighbour
shares `width` symbols with it.

Inserting the symbols of whole documents takes as many rounds as the longest document has bytes, each over everything
inserted so far. Here rounds are bounded instead: the collection is cut into fragments that can be ordered apart.

* Anchors. A string of `width` bytes has one anchor: its leftmost gram (of `gram` bytes) of least hash. Equal strings have
  their anchors at equal offsets, so starts are only compared with starts of the same anchor hash at the same offset, and
  the fragment of an anchor, all strings that it anchors, needs fewer than 2 * width columns, whatever the document.
* Fragments whose whole content occurs elsewhere are decided by 96-bit digests; one of each kind stays in the order as a
  partner for the others. Anchors that occur once have no repeated strings. In periodic runs, strings that repeat at the
  period are decided in place.
* Fragments travel packed, a row for each bucket. An anchor that is hot (more than `hot` kinds in one batch, or more than
  `cap` in all) is not gathered: the digests of its single strings are compared, bucketed by their own value.

Texts are known by 96-bit digests, so copies of a text are one text that counts as repeated.

Defined results: null texts count as empty; texts shorter than `width` lose nothing; rows that repeat a text, with equal or
null ids too, are occurrences of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, byte_rows, lean, mix, slices

WIDTH, GRAM = 400, 128
HOT, CAP = 64, 20_000
PIECE = 1 << 18
DUP, ASK, SERVE, ASK_HOT, SERVE_HOT = 1, 2, 3, 4, 5
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
_ENTRY = np.dtype([("ah", "<u8"), ("f1", "<u8"), ("f2", "<u4"), ("t2", "<u4"), ("t1", "<i8"), ("a", "<i4"), ("n", "<i4"), ("d", "<i2"), ("many", "?")])
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("t2", "<u4"), ("t1", "<i8"), ("a", "<i4"), ("many", "?")])


class Hashes:
    """Two polynomial hashes (modulo 2^64) of any substring of some bytes."""

    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray, count: int = 2):
        n = len(data) + 1
        if not self._powers or len(self._powers[0][0]) < n:
            out = []
            for base in _BASES:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(max(n, PIECE + 2 * WIDTH + 2), np.uint64(b), np.uint64)
                    p[0] = 1
                    pair.append(np.multiply.accumulate(p))
                out.append(tuple(pair))
            if n > PIECE + 2 * WIDTH + 2:
                self._powers = out
            else:
                Hashes._powers = out
        self.sums = []
        for i in range(count):
            s = np.zeros(n, np.uint64)
            np.cumsum(_TABLES[i][data] * self._powers[i][0][: n - 1], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return (s[end] - s[start]) * self._powers[which][1][start]


def _leftmost(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the first least value of every window of `span` values; ties and order by the top 40 bits."""
    bits = 24
    packed = (values & ~np.uint64((1 << bits) - 1)) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if span > size:
        packed = np.minimum(packed[: len(packed) - (span - size)], packed[span - size :])
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def fragments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Fragments of the texts in `data`: (first start, starts, anchor, digests), and spans repeated within a period.

    Returns arrays a, n, p, ah, f1, f2 of positions in `data`, and (start, end) of the spans.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.uint32), none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    values = mix(hashes.of(at, at + gram))
    anchor = _leftmost(values, width - gram + 1)
    left = offsets[np.searchsorted(offsets, np.arange(len(anchor)), side="right")] - np.arange(len(anchor))  # bytes up to the text's end
    valid = left >= width
    starts = np.nonzero(valid)[0]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.uint32), none, none
    p = anchor[starts]
    first = np.nonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))[0]
    a, p = starts[first], p[first]
    n = np.diff(np.concatenate([first, [len(starts)]]))
    ah = values[p]
    doc = np.searchsorted(offsets, a, side="right") - 1
    # runs of a period q: strings equal to those q before them
    q = np.concatenate([[0], p[1:] - p[:-1]])
    maybe = np.concatenate([[False], (ah[1:] == ah[:-1]) & (doc[1:] == doc[:-1])]) & (a - q >= offsets[doc])
    gone = np.zeros(len(a), bool)
    if maybe.any():
        j = np.nonzero(maybe)[0]
        row = np.repeat(np.arange(len(j)), n[j])
        i = np.repeat(a[j], n[j]) + np.arange(len(row)) - np.repeat(np.cumsum(n[j]) - n[j], n[j])
        back = i - q[j][row]
        same = (hashes.of(i, i + width) == hashes.of(back, back + width)) & (hashes.of(i, i + width, 1) == hashes.of(back, back + width, 1))
        gone[j] = np.logical_and.reduceat(same, np.cumsum(n[j]) - n[j])
    span_a, span_b = a[gone] - q[gone], a[gone] + n[gone] - 1 + width
    a, n, p, ah = a[~gone], n[~gone], p[~gone], ah[~gone]
    end = a + n - 1 + width
    shape = mix(((p - a) * 1024 + n).astype(np.uint64))
    return a, n, p, ah, hashes.of(a, end) ^ shape, (mix(hashes.of(a, end, 1)) >> np.uint64(32)).astype(np.uint32), span_a, span_b


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int):
    """(first row, data, offsets, base): runs of whole texts, and long texts in pieces that overlap by width - 1."""
    for a, b in slices(data, offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= PIECE + width:
            yield a, data[lo:hi], offsets[a : b + 1] - lo, 0
            continue
        for s in range(0, hi - lo - width + 1, PIECE):
            e = min(hi - lo, s + PIECE + width - 1)
            yield a, data[lo + s : lo + e], np.array([0, e - s]), s


def _rows(kind, entries, spans=None):
    """Verdict rows (t1, t2, kind, ah, a, n, d): what to do with the strings that start at a .. a + n - 1."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(entries["t1"]), pa.array(entries["t2"].astype(np.int64)), pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(entries))),
            pa.array(np.ascontiguousarray(entries["ah"]).view(np.int64)),
            pa.array(entries["a"].astype(np.int64)), pa.array(entries["n"].astype(np.int64)), pa.array(entries["d"].astype(np.int64)),
        ],
        ["t1", "t2", "kind", "ah", "a", "n", "d"],
    )


def _same(e: np.ndarray, *names: str) -> np.ndarray:
    """Is a row equal to the row before it in these fields."""
    out = np.ones(len(e), bool)
    out[:1] = False
    for name in names:
        out[1:] &= e[name][1:] == e[name][:-1]
    return out


def _emit(buckets: int, width: int, gram: int, hot: int):
    """(t1, t2, text) -> (bucket, entries); bucket -1: verdict entries (kind in `f2`) decided here."""

    def decided(e: np.ndarray, kind: int) -> tuple[int, np.ndarray]:
        e = e.copy()
        e["f2"] = kind
        return -1, e

    def flush(parts: list[np.ndarray]):
        e = np.concatenate(parts)
        if not len(e):
            return
        e = e[np.lexsort((e["a"], e["t2"], e["t1"], e["f2"], e["f1"], e["ah"]))]
        e = e[~_same(e, "ah", "f1", "f2", "t1", "t2", "a")]
        again = _same(e, "ah", "f1", "f2")
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(e))))
        if again.any():
            yield decided(e[again], DUP)
            e["many"][head[again]] = True
            e = e[~again]
        new = ~_same(e, "ah")
        kinds = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        if (kinds > hot).any():  # a hot anchor: its group only hears of it
            mine = e[kinds > hot]
            yield decided(mine[~mine["many"]], ASK_HOT)
            yield decided(mine[mine["many"]], DUP)
            yield decided(mine[mine["many"]], SERVE_HOT)
            rest = (kinds <= hot) | new
            e, kinds = e[rest], kinds[rest]
            e["n"][kinds > hot] = 0
        slot = (e["ah"] >> np.uint64(17)) % np.uint64(buckets)
        order = np.argsort(slot, kind="stable")
        e, slot = e[order], slot[order]
        cuts = np.nonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))[0]
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield int(slot[x]), e[x:y]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["bucket", "entries"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = byte_rows(batch.column("text"))
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for row, part, own, base in _pieces(data, offsets, width):
                a, n, p, ah, f1, f2, span_a, span_b = fragments(part, own, width, gram)
                size += len(part)
                e = np.zeros(len(a) + len(span_a), _ENTRY)
                doc = np.searchsorted(own, np.concatenate([a, span_a]), side="right") - 1
                e["t1"], e["t2"] = t1[row + doc], t2[row + doc]
                local = np.concatenate([a, span_a]) - own[doc] + base
                e["a"] = local
                k = len(a)
                e["n"][:k], e["d"][:k], e["ah"][:k], e["f1"][:k], e["f2"][:k] = n, p - a, ah, f1, f2
                held.append(e[:k])
                if len(span_a):
                    # a span can have more starts than a fragment: cut it
                    spans = []
                    for i in range(k, len(e)):
                        total = int(span_b[i - k] - span_a[i - k] - width + 1)
                        for s in range(0, total, 16384):
                            x = e[i].copy()
                            x["a"], x["n"] = x["a"] + s, min(16384, total - s)
                            spans.append(x)
                    yield out([decided(np.array(spans, _ENTRY), DUP)])
            if size >= 8 << 20:
                rows = list(flush(held))
                if rows:
                    yield out(rows)
                held, size = [], 0
        if held:
            rows = list(flush(held))
            if rows:
                yield out(rows)

    return run


def _by_bucket(batches, column: str, dtype, close, passed=None):
    held, now = [], None
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column(column)):
            e = np.frombuffer(raw.as_buffer(), dtype)
            if bucket < 0:
                yield passed(e)
                continue
            if bucket != now and held:
                yield from close(np.concatenate(held))
                held = []
            now = bucket
            held.append(e)
    if held:
        yield from close(np.concatenate(held))


def _judge(cap: int):
    """Rows (bucket, entries), buckets together -> verdict rows."""

    def close(e):
        e = e[np.lexsort((e["a"], e["t2"], e["t1"], e["f2"], e["f1"], e["ah"]))]
        new_a = ~_same(e, "ah")
        group = np.cumsum(new_a) - 1
        told = np.bincount(group, weights=e["n"] == 0) > 0
        real = e["n"] > 0
        twin = _same(e, "ah", "f1", "f2", "t1", "t2", "a")
        keep = real & ~twin
        # a twin's mark counts for the one that stays
        head = np.maximum.accumulate(np.where(twin, 0, np.arange(len(e))))
        many = np.zeros(len(e), bool)
        np.logical_or.at(many, head, e["many"])
        e, group, many = e[keep], group[keep], many[keep]
        if not len(e):
            return
        new_f = ~_same(e, "ah", "f1", "f2")
        kind_of = np.cumsum(new_f) - 1
        repeated = (np.bincount(kind_of) > 1) | (np.bincount(kind_of, weights=many) > 0)
        kinds = np.bincount(group, weights=new_f, minlength=len(told))
        hot = told | (kinds > cap)
        alone = (kinds <= 1) & ~told
        dup = repeated[kind_of]
        for mask, kind in (
            (dup, DUP),
            (~dup & ~alone[group] & ~hot[group], ASK), (~dup & hot[group], ASK_HOT),
            (dup & new_f & ~alone[group] & ~hot[group], SERVE), (dup & new_f & hot[group], SERVE_HOT),
        ):
            if mask.any():
                yield _rows(kind, e[mask])

    def run(batches):
        yield from _by_bucket(batches, "entries", _ENTRY, close, lambda e: _rows(e["f2"].astype(np.int32), e))

    return run


def _fetch(buckets: int, width: int):
    """(t1, t2, text, asks) -> rows (bucket, meta, bytes): fragments by anchor, and string digests of hot anchors."""

    def run(batches):
        for batch in batches:
            seen: set[tuple] = set()
            by: dict[int, list] = {}
            windows: list[np.ndarray] = []
            for t1, t2, text, asks in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("text"), batch.column("asks").to_pylist()):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                raw = text.as_py().encode()
                for ask in asks:
                    a, n = ask["a"], ask["n"]
                    part = raw[a : a + n - 1 + width]
                    if ask["kind"] in (ASK, SERVE):
                        ah = ask["ah"] & 0xFFFFFFFFFFFFFFFF
                        by.setdefault((ah >> 17) % buckets, []).append(((ah, 0, 0 if ask["kind"] == ASK else 1, t2, t1, a, n, ask["d"], False), part))
                        continue
                    hashes = Hashes(np.frombuffer(part, np.uint8))
                    i = np.arange(n)
                    w = np.zeros(n, _WINDOW)
                    w["h1"], w["h2"] = mix(hashes.of(i, i + width)), mix(hashes.of(i, i + width, 1)) >> np.uint64(32)
                    w["t1"], w["t2"], w["a"] = t1, t2, a + i
                    windows.append(w)
            out: list[tuple] = [(b, np.array([x[0] for x in rows], _ENTRY).tobytes(), b"".join(x[1] for x in rows)) for b, rows in by.items()]
            if windows:
                w = np.concatenate(windows)
                w = w[np.lexsort((w["a"], w["t2"], w["t1"], w["h2"], w["h1"]))]
                again = _same(w, "h1", "h2")
                head = np.maximum.accumulate(np.where(again, 0, np.arange(len(w))))
                w["many"][head[again]] = True
                if again.any():
                    out.append((-1, w[again].tobytes(), b""))
                w = w[~again]
                slot = ((w["h1"] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                w, slot = w[order], slot[order]
                cuts = np.nonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))[0]
                out += [(buckets + int(slot[x]), w[x:y].tobytes(), b"") for x, y in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "meta", "bytes"])

    return run


def column_order(group: np.ndarray, left: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which starts of each fragment are repeated: a boolean row of starts per fragment.

    Fragments are grouped (group non-decreasing); fragment f holds the columns left[f] .. left[f] + lengths[f] - 1 of its
    group's coordinates, its bytes lie end to end in raw. Columns are inserted from the right.
    """
    m = len(group)
    low, right = int(left.min()), left + lengths
    high = int(right.max())
    symbols = np.zeros((m, high - low), np.uint8)
    row = np.repeat(np.arange(m), lengths)
    symbols[row, np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(left - low, lengths)] = raw
    columns = np.ascontiguousarray(symbols.T)
    del symbols, row
    found = np.zeros((m, int(starts.max())), bool)
    by_right = np.argsort(-right, kind="stable")
    entered = 0
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in range(high - 1, low - 1, -1):
        upto = entered
        while upto < m and right[by_right[upto]] == c + 1:
            upto += 1
        fresh = by_right[entered:upto]
        entered = upto
        every = np.concatenate([fresh, order]) if len(fresh) else order
        if not len(every):
            continue
        key = group[every] * 256 + columns[c - low][every]
        to = np.argsort(key, kind="stable")
        key, where = key[to], to - len(fresh)
        # neighbours of one group and symbol share one symbol more than what stood between them
        joined = np.concatenate([[False], key[1:] == key[:-1]])
        at = np.nonzero(joined)[0]
        new = np.zeros(len(every), np.int64)
        before, now = where[at - 1], where[at]
        near = (before >= 0) & (now == before + 1)
        new[at] = 1
        new[at[near]] = common[now[near]] + 1
        far = np.nonzero((before >= 0) & (now > before + 1))[0]
        if len(far):
            pairs = np.empty(2 * len(far), np.int64)
            pairs[0::2], pairs[1::2] = before[far] + 1, now[far] + 1
            padded = np.append(common, 0)
            new[at[far]] = np.minimum.reduceat(padded, pairs)[0::2] + 1
        common = np.minimum(new, width)
        order = every[to]
        best = common.copy()
        best[:-1] = np.maximum(best[:-1], common[1:])
        hit = order[best >= width]
        if len(hit):
            offset = c - left[hit]
            inside = offset < starts[hit]
            found[hit[inside], offset[inside]] = True
        stay = left[order] < c
        if not stay.all():
            kept = np.nonzero(stay)[0]
            if len(kept):
                # what leaves hands its common prefix on to its successor
                low_at = np.concatenate([[0], kept[:-1] + 1])
                common = np.minimum.reduceat(common[: kept[-1] + 1], low_at)
                order = order[kept]
            else:
                order, common = order[:0], common[:0]
    return found


def _span_rows(t1, t2, a, n):
    e = np.zeros(len(a), _ENTRY)
    e["t1"], e["t2"], e["a"], e["n"] = t1, t2, a, n
    return _rows(DUP, e)


def _order(buckets: int, width: int, chunk: int = 16_384):
    """Rows (bucket, meta, bytes), buckets together -> verdict rows of the repeated starts."""

    def fragments_of(parts):
        e = np.concatenate([x[0] for x in parts])
        lengths = e["n"].astype(np.int64) - 1 + width
        where = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(x[1] for x in parts), np.uint8)
        order = np.lexsort((e["a"], e["t2"], e["t1"], e["ah"]))
        order = order[~_same(e[order], "ah", "t1", "t2", "a")]
        e, lengths, where = e[order], lengths[order], where[order]
        edges = np.nonzero(np.concatenate([~_same(e, "ah"), [True]]))[0]
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + chunk, side="right")) - 1)
            lo, hi = int(edges[a]), int(edges[b])
            own, size = e[lo:hi], lengths[lo:hi]
            at = np.repeat(where[lo:hi] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            group = np.cumsum(~_same(own, "ah")) - 1
            found = column_order(group, -own["d"].astype(np.int64), own["n"].astype(np.int64), size, raw[at], width)
            found[own["f2"] == 1] = False  # partners: decided already
            wide = np.zeros((len(own), found.shape[1] + 2), np.int8)
            wide[:, 1:-1] = found
            step = np.diff(wide, axis=1)
            row, first = np.nonzero(step == 1)
            last = np.nonzero(step == -1)[1]
            if len(row):
                yield _span_rows(own["t1"][row], own["t2"][row], own["a"][row] + first, last - first)
            a = b

    def windows_of(parts, known=False):
        w = np.concatenate([x[0] for x in parts])
        if not known:
            w = w[np.lexsort((w["a"], w["t2"], w["t1"], w["h2"], w["h1"]))]
            twin = _same(w, "h1", "h2", "t1", "t2", "a")
            head = np.maximum.accumulate(np.where(twin, 0, np.arange(len(w))))
            many = np.zeros(len(w), bool)
            np.logical_or.at(many, head, w["many"])
            w, many = w[~twin], many[~twin]
            kind = np.cumsum(~_same(w, "h1", "h2")) - 1
            w = w[((np.bincount(kind) > 1) | (np.bincount(kind, weights=many) > 0))[kind]] if len(w) else w
        if not len(w):
            return
        w = w[np.lexsort((w["a"], w["t2"], w["t1"]))]
        joins = _same(w, "t1", "t2")
        joins[1:] &= w["a"][1:] <= w["a"][:-1] + 1
        first = np.nonzero(~joins)[0]
        last = np.concatenate([first[1:], [len(w)]]) - 1
        yield _span_rows(w["t1"][first], w["t2"][first], w["a"][first], w["a"][last] - w["a"][first] + 1)

    def run(batches):
        held, now = [], None

        def close():
            if held:
                yield from (fragments_of if now < buckets else windows_of)(held)

        for batch in batches:
            for bucket, meta, raw in zip(batch.column("bucket").to_pylist(), batch.column("meta"), batch.column("bytes")):
                dtype = _ENTRY if 0 <= bucket < buckets else _WINDOW
                row = (np.frombuffer(meta.as_buffer(), dtype), raw.as_buffer())
                if bucket < 0:
                    yield from windows_of([row], known=True)
                    continue
                if bucket != now:
                    yield from close()
                    held, now = [], bucket
                held.append(row)
        yield from close()

    return run


def _finish(width: int, with_text: bool):
    """(doc_id, text, many, spans) -> kept bytes and figures of each row."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text, many, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("many").to_pylist(), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                runs: list[list[int]] = []
                if many and len(raw) >= width:
                    runs = [[0, len(raw)]]
                elif spans.is_valid and len(spans.values):
                    a = spans.values.field("a").to_numpy()
                    e = a + spans.values.field("n").to_numpy() - 1 + width
                    o = np.argsort(a, kind="stable")
                    a, e = a[o], np.maximum.accumulate(e[o])
                    first = np.concatenate([[True], a[1:] > e[:-1]])
                    runs = [list(x) for x in zip(a[first].tolist(), np.concatenate([e[:-1][first[1:]], e[-1:]]).tolist())]
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                row = (doc, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest())
                out.append((*row, left, [{"start": s, "end": e} for s, e in runs]) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            k = 7 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(k)], names[:k])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, cap: int = CAP, bucket_bytes: int = 16 << 20, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of every row; `kept` are bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    arrow_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), low.alias("t2"))
    long = rows.where(F.octet_length("text") >= width)
    copies = long.groupBy("t1", "t2").agg(F.count("*").alias("rows"), F.max(F.octet_length("text")).alias("size"))
    size = copies.agg(F.sum(F.col("size").cast("long") * F.col("rows"))).collect()[0][0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * least, int(size // bucket_bytes) + 1)
    parts = max(least, min(buckets, 4096))
    verdict = "t1 long, t2 long, kind int, ah long, a long, n long, d long"
    sent = long.select("t1", "t2", "text").mapInArrow(lean(_emit(buckets, width, gram, hot)), "bucket int, entries binary")
    judged = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_judge(cap)), verdict)
    judged = scratch.save(judged, "judged")
    asks = judged.where(F.col("kind") > DUP).groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "ah", "a", "n", "d")).alias("asks"))
    # written, so that both sides of the joins with texts are plain exchanges, which Spark splits where copies pile up
    asked = long.select("t1", "t2", "text").join(scratch.save(asks, "asks"), ["t1", "t2"])
    fetched = asked.select("t1", "t2", "text", "asks").mapInArrow(lean(_fetch(buckets, width)), "bucket int, meta binary, bytes binary")
    ordered = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_order(buckets, width)), verdict)
    repeats = judged.where(F.col("kind") == DUP).unionByName(ordered)
    many = copies.where("rows > 1").select("t1", "t2", F.lit(True).alias("many"))
    spans = repeats.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    known = scratch.save(spans.join(many, ["t1", "t2"], "full"), "known")
    scratch.drop("judged", "asks")
    both = rows.join(known, ["t1", "t2"], "left").select("doc_id", "text", "many", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:bigint,end:bigint>>" if with_text else "")
    return both.mapInArrow(lean(_finish(width, with_text)), schema)
