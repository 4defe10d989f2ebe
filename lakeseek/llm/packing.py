"""Sequence packing by cutting-stock column generation.

Documents become token pieces of at most `seq_len` ids. Piece lengths, rounded up to a grain, form a histogram of at most
seq_len / grain classes whatever the number of documents. Over that histogram the Gilmore-Gomory linear program is
solved on the driver: a knapsack dynamic program prices new patterns against the dual values until none improves the
master. Patterns are rounded down, the few pieces left are packed first-fit decreasing, and the pieces of each class, in
rank order, are dealt to the pattern slots by arithmetic on their rank.

Defined results: a null text counts as empty and is one piece of the end id alone; rows with equal or null ids are packed
like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, lean

END_ID = 1
#: A class is ranked in buckets of LEAST_ROWS pieces or more until it has MANY of them, then in ever more of MOST_ROWS.
LEAST_ROWS, MANY, MOST_ROWS = 256, 256, 65_536
#: The number of buckets up to which their offsets are broadcast.
BROADCAST_BUCKETS = 200_000


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """str -> uint32 ids, with the vocabulary of a byte-level BPE file of the `tokenizers` library.

    In these files ids number the merges in order, so the byte-pair core of tiktoken gives the same ids several times
    faster (tests hold the two against each other). Added tokens of the file, such as a literal end of text, are cut out of
    a text and give their own id, as `tokenizers` does by default. Texts the pattern engine refuses go to `tokenizers`.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    # the printable stand-ins that byte-level vocabularies use for bytes
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the pattern engine's own limits on very long runs
            return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return ids


def _pieces(path: str, seq_len: int, end_id: int, payload: str):
    """Arrow batches of (doc_id, text) -> pieces."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "key", "start", "length", "doc_tokens", "payload")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                key = zlib.crc32(raw)
                for s in range(0, n, seq_len):
                    part = raw[4 * s : 4 * (s + seq_len)]
                    rows["doc_id"].append(doc)
                    rows["key"].append(key)
                    rows["start"].append(s)
                    rows["length"].append(len(part) // 4)
                    rows["doc_tokens"].append(n)
                    rows["payload"].append(zlib.crc32(part) if payload == "crc32" else part)
            kind = pa.int64() if payload == "crc32" else pa.binary()
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, kind if k == "payload" else pa.int64()) for k, v in rows.items()}
            )

    return run


def tokenize(docs: DataFrame, path: str, seq_len: int, end_id: int, payload: str) -> DataFrame:
    kind = "long" if payload == "crc32" else "binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        lean(_pieces(path, seq_len, end_id, payload)), f"doc_id long, key long, start long, length long, doc_tokens long, payload {kind}"
    )


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of an unbounded knapsack of greatest value, by dynamic programming over capacities."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    # a size that a smaller one of no less worth stands for is never needed
    order = np.argsort(sizes, kind="stable")
    order = order[values[order] > np.concatenate([[0.0], np.maximum.accumulate(values[order])[:-1]])]
    small, worth = sizes[order], values[order]
    fit = np.searchsorted(small, np.arange(capacity + 1), side="right").tolist()
    for c, n in enumerate(fit):
        if not n:
            continue
        got = best[c - small[:n]] + worth[:n]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-15:
            best[c], take[c] = got[i], order[i]
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int):
    """(patterns, counts, inverse): a basis to start from, by first-fit decreasing patterns, each used until a class runs out.

    A class that has run out is in no later pattern: with the classes in the order they run out the basis is triangular,
    so the patterns are independent whatever the demand, and the inverse comes by substitution.
    """
    m = len(sizes)
    patterns, x, inverse = np.zeros((m, m), np.int64), np.zeros(m), np.zeros((m, m))
    left, live, order = demand.astype(float), np.ones(m, bool), []
    for _ in range(m):
        column, room = np.zeros(m, np.int64), capacity
        for i in np.nonzero(live)[0][np.argsort(-sizes[live], kind="stable")]:
            column[i], room = divmod(room, int(sizes[i]))
            if not room:
                break
        ratio = np.where(column > 0, left / np.maximum(column, 1), np.inf)
        r = int(np.argmin(ratio))
        patterns[:, r], x[r] = column, ratio[r]
        left = np.maximum(left - ratio[r] * column, 0)
        left[r], live[r] = 0, False
        order.append(r)
    for k, r in enumerate(order):
        own = np.zeros(m)
        own[r] = 1
        for j in order[:k]:
            if patterns[r, j]:
                own -= patterns[r, j] * inverse[j]
        inverse[r] = own / patterns[r, r]
    return patterns, x, inverse


def solve_cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, max_columns: int = 20_000):
    """(patterns, fractional counts) of the linear program min sum(x), patterns @ x = demand, by column generation.

    The master starts from first-fit decreasing patterns; the knapsack prices new ones against its dual values until none
    improves it, or sum(x) is within 1 + gap of a lower bound of the optimum (the total volume, or Farley's bound). A
    master that has not come so far after max_columns columns is used as it is, with a warning.
    """
    m = len(sizes)
    patterns, x, inverse = first_basis(sizes, demand, capacity)
    bound = float(sizes @ demand) / capacity
    for _ in range(max_columns):
        if x.sum() <= bound * (1 + gap):
            break
        duals = np.maximum(inverse.sum(axis=0), 0)
        column = knapsack(sizes, duals, capacity)
        worth = duals @ column
        bound = max(bound, duals @ demand / max(worth, 1.0))
        if inverse.sum(axis=0) @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-10)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        patterns[:, r] = column
        row = inverse[r] / step[r]
        t = x[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        x = np.maximum(x - t * step, 0)
        x[r] = t
    else:
        warnings.warn(f"the cutting-stock program stopped after {max_columns} columns", stacklevel=2)
    return patterns, x


def plan_layout(histogram: dict[int, int], capacity: int):
    """Integral patterns over classes: [(class -> count, copies)], the rounded program first, then the rest.

    Also the number of sequences that come from the rounded program.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns, x = solve_cutting_stock(sizes, demand.astype(float), capacity)
    layout, left = [], demand.copy()
    for j in np.argsort(-x, kind="stable"):
        used = patterns[:, j]
        copies = int(np.floor(x[j] + 1e-9))
        if used.any():
            copies = min(copies, int((left[used > 0] // used[used > 0]).min()))
            if copies > 0:
                left -= copies * used
                layout.append(({int(sizes[i]): int(used[i]) for i in np.nonzero(used)[0]}, copies))
    planned = sum(c for _, c in layout)
    bins: list[list] = []  # [free, {class: count}], first-fit decreasing
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            for b in bins:
                if b[0] >= sizes[i]:
                    break
            else:
                bins.append(b := [capacity, {}])
            b[0] -= int(sizes[i])
            b[1][int(sizes[i])] = b[1].get(int(sizes[i]), 0) + 1
    layout += [(b[1], 1) for b in bins]
    return layout, planned


def slot_table(layout) -> dict[int, np.ndarray]:
    """Per class: rows (first rank, first sequence, pieces per sequence, first slot), by rank."""
    table: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, copies in layout:
        slot = 0
        for cls in sorted(pattern, reverse=True):
            n = pattern[cls]
            table.setdefault(cls, []).append((rank.get(cls, 0), sequence, n, slot))
            rank[cls] = rank.get(cls, 0) + n * copies
            slot += n
        sequence += copies
    return {c: np.array(v, dtype=np.int64) for c, v in table.items()}


def _deal(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.nonzero(cls == c)[0]
                rows = table[int(c)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], slot[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2]
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])

    return run


def _cut(capacity: int):
    """Pieces of under-filled sequences, cut at the powers of two that add up to the sequence's length."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, ends, total = 0, [], r["fill"]
                while a < total:
                    a += 1 << min((total - a).bit_length() - 1, capacity.bit_length() - 1)
                    ends.append(a)
                begin = 0
                for i, end in enumerate(ends):
                    lo, hi = max(begin, r["offset"]), min(end, r["offset"] + r["length"])
                    if lo < hi:
                        out.append(
                            {
                                "doc_id": r["doc_id"], "key": r["key"], "was": r["start"], "start": r["start"] + lo - r["offset"], "length": hi - lo,
                                "doc_tokens": r["doc_tokens"], "sequence_id": r["sequence_id"], "part": i, "offset": lo - begin,
                            }
                        )
                    begin = end
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(k, pa.int64()) for k in ("doc_id", "key", "was", "start", "length", "doc_tokens", "sequence_id", "part", "offset")]))

    return run


def _slice_payload(payload: str):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = 4 * (r["start"] - r["was"])
                part = r.pop("ids")[a : a + 4 * r["length"]]
                r["payload"] = zlib.crc32(part) if payload == "crc32" else part
                out.append(r)
            kind = pa.int64() if payload == "crc32" else pa.binary()
            names = ("doc_id", "start", "length", "payload", "doc_tokens", "sequence_id", "offset")
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in out], schema=pa.schema([(k, kind if k == "payload" else pa.int64()) for k in names]))

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    seq_len: int = 2048,
    grain: int = 8,
    end_id: int = END_ID,
    payload: str = "ids",
    max_padding: int = 64,
) -> DataFrame:
    """Pieces (doc_id, start, length, payload, doc_tokens, sequence_id, offset) of all documents.

    payload: "ids" carries each piece's ids as little-endian uint32 bytes, "crc32" only their CRC. seq_len must be a power
    of two. Sequences left over by the rounding that would need more than max_padding ids of padding are cut at powers
    of two, which need none. The program has at most seq_len / grain classes; nothing else reaches the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    capacity = seq_len // grain
    arrow_batches(spark)
    pieces = scratch.save(tokenize(docs, tokenizer, seq_len, end_id, payload), "pieces")
    pieces = pieces.withColumn("cls", F.ceil(F.col("length") / grain).cast("long"))
    histogram = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    names = ("doc_id", "start", "length", "payload", "doc_tokens", "sequence_id", "offset")
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).select(*names)
    layout, planned = plan_layout(histogram, capacity)
    total = sum(c for _, c in layout)

    # rank in the class without gathering a class: rank in a (class, bucket) plus the bucket's offset; buckets by class size
    buckets = {c: max(min(MANY, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS)) for c, n in sorted(histogram.items())}
    dealt_to = F.create_map(*(F.lit(x).cast("long") for pair in buckets.items() for x in pair))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "key"), F.element_at(dealt_to, F.col("cls"))).cast("int"))
    within = Window.partitionBy("cls", "bucket").orderBy("doc_id", "start", "key")
    before = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("cls", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row for each bucket
    ranked = pieces.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(sizes) if sum(buckets.values()) <= BROADCAST_BUCKETS else sizes, ["cls", "bucket"])
    ranked = ranked.select("doc_id", "key", "start", "length", "doc_tokens", "payload", "cls", (F.col("first") + F.col("k")).cast("long").alias("rank"))
    kind = "long" if payload == "crc32" else "binary"
    dealt = ranked.mapInArrow(
        _deal(slot_table(layout)),
        f"doc_id long, key long, start long, length long, doc_tokens long, payload {kind}, cls long, rank long, sequence_id long, slot long",
    )
    inside = Window.partitionBy("sequence_id")
    placed = dealt.withColumns(
        {
            "offset": F.coalesce(F.sum("length").over(inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
            "fill": F.sum("length").over(inside),
        }
    )
    placed = scratch.save(placed.drop("cls", "rank", "slot"), "placed")
    scratch.drop("pieces")
    loose = (F.col("sequence_id") >= planned) & (F.col("fill") < seq_len - max_padding)
    # of the sequences the rounding left over only: fewer than classes, whatever the input
    cut = scratch.save(placed.where(loose).drop("payload").mapInArrow(_cut(seq_len), "doc_id long, key long, was long, start long, length long, doc_tokens long, sequence_id long, part long, offset long"), "cut")
    whole = placed.where(~loose).select(*names)
    n_cut = cut.count()
    if not n_cut:
        return whole
    cut = cut.withColumn("sequence_id", F.lit(total) + F.col("sequence_id") * seq_len.bit_length() * 2 + F.col("part"))
    wanted = cut.select("doc_id").distinct()
    arrow_batches(spark)
    again = docs.join(F.broadcast(wanted), docs["doc_id"].cast("long").eqNullSafe(wanted["doc_id"]), "left_semi")
    ids = tokenize(again, tokenizer, seq_len, end_id, "ids").select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("s"), F.col("payload").alias("ids")
    ).dropDuplicates(["d", "k", "s"])
    parts = cut.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("was") == F.col("s")))
    parts = scratch.save(
        parts.drop("d", "k", "s").mapInArrow(
            _slice_payload(payload), f"doc_id long, start long, length long, payload {kind}, doc_tokens long, sequence_id long, offset long"
        ),
        "parts",
    )
    return whole.unionByName(parts)
