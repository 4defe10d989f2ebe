"""Substring deduplication by line and phrase hashing.

Units are lines, and inside a line phrases: a line is cut after a word whose hash is divisible by three unless one of the
two words before it (in the line) is such a word too. Cuts depend on nearby words only, so a passage that was pasted into
a longer line has the same phrases there as elsewhere. Units are normalised (ASCII lower case, punctuation and spacing
dropped) and known by 128-bit digests.

Digests are grouped globally; the occurrence of the smallest rank (doc_id, unit number) stays. A task sends one occurrence
of each digest for every few MB of text it reads, so a unit that sits in a third of all documents reaches its group a few
thousand times less often; the other occurrences are known to be later ones already. Digests travel as packed arrays, one
row for each bucket, and buckets follow the size of the input.

What is removed: runs of consecutive repeated units of `min_words` words or more, and in shorter runs complete lines of
`line_words` words or more; with `short_lines` also the later occurrences of shorter lines, known by a digest of the whole
line, so that a word that ends a longer line elsewhere does not count. Words are parted by white space; text without spaces
counts by its bytes. Spans are byte offsets into the original UTF-8 text, up to the next kept word.

Defined results: a null text counts as empty and stays empty; rows that agree in id and text are one occurrence and get
the same result; null ids rank last; texts without words lose nothing; an empty table gives no rows; extra columns stay,
unless named like a column of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, byte_rows, lean, mix, slices

LAST = np.iinfo(np.int64).max
PIECE = 1 << 18
#: A longer word (in bytes of letters and digits) is text without spaces, and counts as a word for every so many bytes.
UNSPACED, WORD_BYTES = 24, 6
#: Added to the number of its first unit, the number of a whole line.
WHOLE = 1 << 30
_BYTES = np.arange(256)
SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
BREAK = np.isin(_BYTES, [10, 11, 12, 13])
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_KEPT = ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
_VALUE = np.where(_KEPT, mix(_LOWER.astype(np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1), np.uint64(0))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
OWN = ("removed_spans", "removed_units", "n_bytes")
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("unit", "<i4")])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _within(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position the number of flagged ones before it since its group's first position."""
    before = np.cumsum(flag) - flag
    return before - before[first]


class Units:
    """Units of many texts laid end to end: doc (row), number in the text, start, end, words, h1, h2, line.

    They are found in pieces of about PIECE bytes, cut between texts or after line breaks, where no unit crosses; working
    memory is some eighty times a piece.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.nonzero(BREAK[data])[0] + 1 if len(data) > PIECE else np.zeros(0, np.int64)
        cuts = np.union1d(offsets, breaks)
        parts, at, lines = [], 0, 0
        while at < len(data):
            end = int(cuts[max(np.searchsorted(cuts, at + PIECE, side="right") - 1, np.searchsorted(cuts, at, side="right"))])
            a, b = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, end, side="left")
            part = _Piece(data[at:end], np.clip(offsets[a : b + 1], at, end) - at)
            parts.append((part.doc + a, part.start + at, part.words, part.line + lines, part.h1, part.h2))
            lines += int(part.line[-1]) + 1 if len(part.line) else 0
            at = end
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2]
        self.doc, self.start, self.words, self.line, self.h1, self.h2 = columns
        self.offsets = offsets
        self.number = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc, side="left")
        # up to the next word of the text, or its end
        following = np.concatenate([self.start[1:], offsets[-1:]]) if len(self.start) else self.start
        self.end = np.minimum(following, offsets[self.doc + 1])

    def short_lines(self, line_words: int):
        """(first unit, h1, h2) of the lines of one word up to `line_words` - 1."""
        at = np.searchsorted(self.line, np.arange(int(self.line[-1]) + 1 if len(self.line) else 0))
        if not len(at):
            return at, self.h1, self.h2
        live = self.words > 0
        rank = _within(live, at[self.line])
        place = _powers(_ODD[1], int(rank.max()) + 1)[rank]
        words = np.add.reduceat(self.words, at)
        own = (words > 0) & (words < line_words)
        h1, h2 = (np.add.reduceat(np.where(live, mix(h + _ODD[0]) * place, np.uint64(0)), at)[own] for h in (self.h1, self.h2))
        return at[own], mix(h1 ^ _ODD[1]), mix(h2 ^ _ODD[2])


class _Piece:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]) if len(data) else np.zeros(0, bool)
        starts = np.nonzero(begin)[0]
        if not len(starts):
            for name in ("doc", "start", "words", "line"):
                setattr(self, name, np.zeros(0, np.int64))
            self.h1 = self.h2 = np.zeros(0, np.uint64)
            return
        word_of = np.cumsum(begin) - 1
        kept = _KEPT[data] & solid
        place = _within(kept, starts[np.maximum(word_of, 0)])
        terms = _VALUE[data] * _powers(_ODD[0], int(place.max()) + 1)[place]
        terms[~solid] = 0
        h = np.add.reduceat(terms, starts)
        size = np.add.reduceat(kept.astype(np.int64), starts)
        real = size > 0
        wh = mix(h ^ np.uint64(0xA5A5A5A5))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(BREAK[data])])[starts]
        new_line = np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])])
        line = np.cumsum(new_line) - 1
        cond = real & (wh % np.uint64(3) == 0)
        back = np.zeros(len(cond), bool)
        back[1:] |= cond[:-1] & (line[1:] == line[:-1])
        back[2:] |= cond[:-2] & (line[2:] == line[:-2])
        cut = (cond & ~back) | np.concatenate([new_line[1:], [True]])
        first = np.concatenate([[True], cut[:-1]])
        at = np.nonzero(first)[0]
        unit_of = np.cumsum(first) - 1
        rank = _within(real, at[unit_of])
        top = int(rank.max()) + 1
        zero = np.where(real, wh, np.uint64(0))
        self.h1 = np.add.reduceat(zero * _powers(_ODD[1], top)[rank], at)
        self.h2 = np.add.reduceat(np.where(real, mix(wh + _ODD[2]), np.uint64(0)) * _powers(_ODD[2], top)[rank], at)
        self.words = np.add.reduceat(np.where(size > UNSPACED, size // WORD_BYTES, real), at)
        self.doc, self.line, self.start = doc[at], line[at], starts[at]


def text_key(raw: bytes) -> int:
    import zlib

    return zlib.crc32(raw)


def _emit(buckets: int, short: int, flush: int = 8 << 20):
    """Arrow batches of (doc_id, text) -> rows (bucket, entries): candidates, and under a negative bucket repeats."""

    def pack(docs, keys, data, offsets):
        units = Units(data, offsets)
        live = np.nonzero(units.words > 0)[0]
        line, h1, h2 = units.short_lines(short)
        at = np.concatenate([live, line])
        e = np.zeros(len(at), _ENTRY)
        e["h1"], e["h2"] = np.concatenate([units.h1[live], h1]), np.concatenate([units.h2[live], h2])
        e["unit"] = np.concatenate([units.number[live], units.number[line] + WHOLE])
        e["doc"], e["key"] = docs[units.doc[at]], keys[units.doc[at]]
        e = e[np.lexsort((e["unit"], e["key"], e["doc"], e["h2"], e["h1"]))]
        if not len(e):
            return
        same = np.concatenate([[False], (e["h1"][1:] == e["h1"][:-1]) & (e["h2"][1:] == e["h2"][:-1])])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(e))))
        self_again = (e["doc"] == e["doc"][head]) & (e["key"] == e["key"][head]) & (e["unit"] == e["unit"][head])
        later = e[same & ~self_again]
        if len(later):
            yield -1 - int(later["doc"][0] % buckets), later
        e = e[~same]
        slot = (e["h1"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(slot, kind="stable")
        e, slot = e[order], slot[order]
        cuts = np.nonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))[0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(slot[a]), e[a:b]

    def run(batches):
        for batch in batches:
            data, offsets = byte_rows(batch.column(1))
            docs = batch.column(0).fill_null(LAST).to_numpy()
            keys = np.array([text_key(data[a:b]) for a, b in zip(offsets, offsets[1:])], np.uint32)
            for a, b in slices(data, offsets, flush):
                rows = list(pack(docs[a:b], keys[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["bucket", "entries"]
                    )

    return run


def _repeats(batches):
    """Rows (bucket, entries), a bucket's rows together -> (doc_id, key, units) of the occurrences that are not earliest."""

    def by_doc(e):
        e = e[np.lexsort((e["unit"], e["key"], e["doc"]))]
        cuts = np.nonzero(np.concatenate([[True], (e["doc"][1:] != e["doc"][:-1]) | (e["key"][1:] != e["key"][:-1])]))[0]
        ends = np.concatenate([cuts, [len(e)]]).astype(np.int32)
        doc = e["doc"][cuts]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=doc == LAST), pa.array(e["key"][cuts].astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(e["unit"])))],
            ["doc_id", "key", "units"],
        )

    def close(bucket, parts):
        e = np.concatenate(parts)
        if bucket >= 0:
            e = e[np.lexsort((e["unit"], e["key"], e["doc"], e["h2"], e["h1"]))]
            same = np.concatenate([[False], (e["h1"][1:] == e["h1"][:-1]) & (e["h2"][1:] == e["h2"][:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(e))))
            e = e[same & ((e["doc"] != e["doc"][head]) | (e["key"] != e["key"][head]) | (e["unit"] != e["unit"][head]))]
        if len(e):
            yield by_doc(e)

    held, now = [], None
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("entries")):
            if bucket != now and held:
                yield from close(now, held)
                held = []
            now = bucket
            held.append(np.frombuffer(raw.as_buffer(), _ENTRY))
            if now < 0:  # known to be repeats: nothing to wait for
                yield by_doc(held.pop())
    if held:
        yield from close(now, held)


def removed_spans(units: Units, flagged: np.ndarray, min_words: int, line_words: int, again: np.ndarray):
    """(doc, start, end, units) of the spans to remove; again: first units of short lines that are later occurrences."""
    soft = flagged | (units.words == 0)
    change = np.ones(len(soft) + 1, bool)
    change[1:-1] = (soft[1:] != soft[:-1]) | (units.doc[1:] != units.doc[:-1])
    cuts = np.nonzero(change)[0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if not soft[a]:
            continue
        hard = np.nonzero(flagged[a:b])[0]
        if not len(hard):
            continue
        a, b = a + int(hard[0]), a + int(hard[-1]) + 1
        if units.words[a:b].sum() >= min_words:
            yield int(units.doc[a]), int(units.start[a]), int(units.end[b - 1]), b - a
            continue
        lines = units.line[a:b]
        for line in np.unique(lines):
            i, j = int(np.searchsorted(units.line, line)), int(np.searchsorted(units.line, line, side="right"))
            if again[i]:
                yield int(units.doc[i]), int(units.start[i]), int(units.end[j - 1]), j - i
                continue
            i, j = a + int(np.searchsorted(lines, line)), a + int(np.searchsorted(lines, line, side="right"))
            whole = (i == 0 or units.line[i - 1] != line) and (j == len(units.line) or units.line[j] != line)
            if whole and units.words[i:j].sum() >= line_words:
                yield int(units.doc[i]), int(units.start[i]), int(units.end[j - 1]), j - i


def _remove(min_words: int, line_words: int):
    """Arrow batches (doc_id, text, units, carried...) -> with kept text and spans."""

    def run(batches):
        for batch in batches:
            data, offsets = byte_rows(batch.column("text"))
            lists = batch.column("__units").to_pylist()
            texts, spans, gone = batch.column("text").to_pylist(), [[] for _ in lists], [0] * len(lists)
            for a, b in slices(data, offsets, 8 << 20):
                if not any(lists[a:b]):
                    continue
                base = int(offsets[a])
                units = Units(data[base : offsets[b]], offsets[a : b + 1] - base)
                first = np.searchsorted(units.doc, np.arange(b - a))
                flagged, again = np.zeros((2, len(units.doc)), bool)
                for i in range(a, b):
                    if lists[i]:
                        own = np.array(lists[i], np.int64)
                        flagged[first[i - a] + own[own < WHOLE]] = True
                        again[first[i - a] + own[own >= WHOLE] - WHOLE] = True
                for doc, s, e, n in removed_spans(units, flagged, min_words, line_words, again):
                    own = int(units.offsets[doc])
                    spans[a + doc].append({"start": s - own, "end": e - own})
                    gone[a + doc] += n
            for i, own in enumerate(spans):
                if own:
                    raw, at, parts = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                    for s in own:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*parts, raw[at:]]).decode()
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            names = [n for n in batch.schema.names if n not in ("__units", "text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([t or "" for t in texts], pa.string()), pa.array(spans, kind), pa.array(gone, pa.int64()), pa.array(np.diff(offsets))],
                [*names, "text", "removed_spans", "removed_units", "n_bytes"],
            )

    return run


def dedup_lines(docs: DataFrame, min_words: int = 16, line_words: int = 6, bucket_bytes: int = 16 << 20, short_lines: bool = False) -> DataFrame:
    """Every row of `docs` with its remaining text, and removed_spans, removed_units and n_bytes (of the original).

    short_lines: later occurrences of whole lines go whatever their number of words.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * least, int(size // bucket_bytes) + 1)
    arrow_batches(spark)
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(_emit(buckets, line_words if short_lines else 0)), "bucket int, entries binary")
    parts = max(least, min(buckets, 4096))
    later = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_repeats), "doc_id long, key long, units array<int>")
    by_doc = later.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("units")).alias("units"))
    # inside, the other columns go by their places, so that no name of theirs meets one of ours
    rest = [f for f in docs.schema if f.name.lower() not in ("text", *OWN)]
    carried = [f"c{i}" for i in range(len(rest))]
    key = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = docs.select(*(F.col(f"`{f.name}`").alias(c) for f, c in zip(rest, carried)), "text", F.col("doc_id").cast("long").alias("__id"), key.alias("__crc"))
    both = keyed.join(by_doc, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__crc") == F.col("key")), "left")
    fields = "".join(f"{c} {f.dataType.simpleString()}, " for f, c in zip(rest, carried))
    out = both.select(*carried, "text", F.col("units").alias("__units")).mapInArrow(
        lean(_remove(min_words, line_words)), f"{fields}text string, removed_spans array<struct<start:bigint,end:bigint>>, removed_units long, n_bytes long"
    )
    return out.toDF(*(f.name for f in rest), "text", *OWN)
