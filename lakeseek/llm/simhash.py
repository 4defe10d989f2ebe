"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints count, for each bit, the shingle hashes that have it. The self-join walks pairs of trie nodes together from
the top bit down: a pair's children inherit its number of differing bits, and pairs beyond the Hamming budget are dropped
with all below them. A trie node is a range of a sorted array, so a whole level of pairs is a few numpy operations.

The trie is dealt out by pigeonhole: of budget + 1 bit blocks two linked fingerprints agree on one at least, so each
distinct fingerprint goes to one group for each of its blocks. A group of more than `split` members is cut into pairs of
trie nodes a few bits down, so no task has to hold it whole. Groups return a spanning forest of their links, not the
links, and components are joined in DataFrames.

Near duplicates by similarity take the same way with a wide fingerprint of distinct shingles, walked as tries from many
places on with a smaller budget; what these self-joins propose is then decided by exact comparison of the shingle sets.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other;
repeated rows share a fingerprint; rows with null ids link like any other and get the smallest id they reach, or null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, components, lean, mix

SEED = 42
#: Node pairs no larger than this product are compared directly.
LEAF = 256
#: Node pairs handled at once; more wait on a stack.
FRONT = 1 << 17
#: Leading bits of a turn of a wide fingerprint, of which few may differ.
TOP = 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words (A-Z lowered, ASCII white space); fewer words make one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(length) - 1
    starts = (ends + 1 - length)[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where more than half of the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = hashes[a : a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print): the fingerprint's 64 bits as a signed number."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(_fingerprints(size)), "doc_id long, print long")


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        a, b = parent[i], parent[j]
        live = a != b
        if not live.any():
            return
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _pairs(alo, ahi, blo, bhi):
    """Index pairs of ranges a x b, for many ranges at once."""
    nb = bhi - blo
    n = (ahi - alo) * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return alo[at] + k // nb[at], blo[at] + k % nb[at]


def trie_forest(key: np.ndarray, first: np.ndarray, last: np.ndarray, budget: int, top: tuple[int, int] | None = None, also=None) -> np.ndarray:
    """Root index of every row's class, by links inside each range [first, last) of rows sorted by (range, key).

    Rows link when their keys differ in at most `budget` bits; with top = (bits, most), also in at most `most` of the leading
    bits and when also(i, j) holds. Near copies crowd there, so neighbours are linked first, and pairs of nodes that lie in
    one class already are dropped with all below them.
    """
    parent = np.arange(len(key))
    run = parent
    bits, most = top or (64, budget)
    leaf = 32 if top else LEAF

    def near(i, j):
        apart = key[i] ^ key[j]
        ok = np.bitwise_count(apart) <= budget
        if top:
            ok &= np.bitwise_count(apart >> np.uint64(64 - bits)) <= most
        if also is not None:
            ok[ok] = also(i[ok], j[ok])
        return ok

    def runs():
        return np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])

    if top and len(key):
        i = np.ones(len(key), bool)
        i[last - 1] = False
        inside = np.zeros(len(key) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        i = np.nonzero(i & (np.cumsum(inside)[:-1] > 0))[0]
        i = i[near(i, i + 1)]
        _unite(parent, i, i + 1)
        run = runs()
    stack = [(0, first, last, first, last, np.zeros(len(first), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if top:
            apart = (run[alo] != run[ahi - 1]) | (run[blo] != run[bhi - 1]) | (parent[alo] != parent[blo])
            alo, ahi, blo, bhi, err = (x[apart] for x in (alo, ahi, blo, bhi, err))
        if len(alo) > FRONT:
            h = len(alo) // 2
            stack += [(depth, *(x[:h] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[h:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (depth == 64)
        if small.any():
            todo = np.nonzero(small)[0]
            sizes = np.cumsum((ahi - alo)[todo] * (bhi - blo)[todo])
            found = False
            for part in np.split(todo, np.searchsorted(sizes, np.arange(FRONT, sizes[-1], FRONT))):
                i, j = _pairs(alo[part], ahi[part], blo[part], bhi[part])
                i, j = i[i < j], j[i < j]
                linked = near(i, j)
                if linked.any():
                    found = True
                    _unite(parent, i[linked], j[linked])
            if found and top:
                run = runs()
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        # below a node, bit 63 - depth parts its range: the first row that has it
        bit = np.uint64(63 - depth)
        has = np.concatenate([[0], np.cumsum((key >> bit & np.uint64(1)).astype(np.int64))])
        amid, bmid = ahi - (has[ahi] - has[alo]), bhi - (has[bhi] - has[blo])
        same = alo == blo
        kids = [
            (alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids))
        live = (ahi > alo) & (bhi > blo) & (err <= (most if depth < bits else budget))
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))
        if not live.any():
            stack.pop()
    return parent


def _join(budget: int, flush: int):
    """Arrow batches (key, print) sorted by both -> (a, b) links that span each group's classes."""

    def links(keys, prints):
        prints = prints.view(np.uint64)  # unsigned order is what the trie needs
        order = np.lexsort((prints, keys))
        keys, prints = keys[order], prints[order]
        edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))[0]
        first, last = edge[:-1], edge[1:]
        many = last - first > 1
        root = trie_forest(prints, first[many], last[many], budget)
        at = np.nonzero(root != np.arange(len(root)))[0]
        return pa.RecordBatch.from_arrays([pa.array(prints[at].view(np.int64)), pa.array(prints[root[at]].view(np.int64))], ["a", "b"])

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("key").to_numpy(), batch.column("print").to_numpy()))
            rows += batch.num_rows
            if rows >= flush:
                keys, prints = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1], side="left"))
                if cut:
                    yield links(keys[:cut], prints[:cut])
                held, rows = [(keys[cut:], prints[cut:])], 0
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _split_keys(grouped: DataFrame, split: int, budget: int) -> DataFrame:
    """Cuts groups of more than `split` members into pairs of trie nodes some bits down; rows (key, print).

    A member goes to each pair that its node takes part in, if the two nodes differ in at most `budget` bits. Nodes are at
    most 16 bits deep, which is enough for groups of 32,768 * split members.
    """
    sizes = grouped.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split)
    hot = sizes.select("key", F.least(F.ceil(F.log2(F.col("n") / split)) + 1, F.lit(16)).cast("int").alias("depth"))
    if not hot.take(1):
        return grouped
    # spread over the print by a rule that keeps Hamming distance: every 6th bit, which no block holds whole
    node = "cast(aggregate(sequence(0, depth - 1), 0L, (s, i) -> s * 2 + (shiftrightunsigned(print, pmod(i * 6 + 3, 64)) & 1)) as bigint)"
    others = f"filter(sequence(0L, shiftleft(1L, depth) - 1), x -> bit_count(x ^ node) <= {budget})"
    parts = (
        grouped.join(hot, "key")
        .withColumn("node", F.expr(node))
        .withColumn("other", F.explode(F.expr(others)))
        .withColumn("key", F.xxhash64("key", F.least("node", "other"), F.greatest("node", "other")))
        .select("key", "print")
    )
    return grouped.join(hot, "key", "left_anti").select("key", "print").unionByName(parts)


def linked_prints(prints: DataFrame, scratch: Scratch, budget: int, split: int = 50_000) -> DataFrame:
    """(node, component) of the distinct fingerprints `print` that link with another: the least print reachable."""
    cuts = [round(i * 64 / (budget + 1)) for i in range(budget + 2)]
    blocks = [F.xxhash64(F.lit(i), F.shiftrightunsigned(F.shiftleft(F.col("print"), 64 - b), 64 - b + a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    grouped = _split_keys(prints.select(F.explode(F.array(*blocks)).alias("key"), "print"), split, budget)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.repartition(n, "key").sortWithinPartitions("key")
    edges = scratch.save(dealt.mapInArrow(lean(_join(budget, 1 << 17)), "a long, b long"), "edges")
    return components(edges, scratch, "simhash")


def simhash_components(docs: DataFrame, size: int = 5, budget: int = 4, split: int = 50_000) -> DataFrame:
    """(doc_id, fingerprint, component_id): classes of 64-bit fingerprints linked at `budget` or fewer differing bits."""
    scratch = Scratch(docs.sparkSession)
    arrow_batches(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, size), "prints")
    distinct = scratch.save(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    found = linked_prints(distinct, scratch, budget, split)
    known = distinct.join(found, distinct["print"] == found["node"], "left").select("print", "least", F.coalesce("component", "print").alias("c"))
    # a class's smallest id: rows without an id link others, but name nothing
    ids = known.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = scratch.save(known.join(ids, "c").select("print", "component_id"), "classes")
    return prints.join(classes, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a shingle counts once however often a text has it."""
    return np.unique(shingle_hashes(text, size))


def _set_digest(own: np.ndarray) -> tuple[int, int]:
    raw = own.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, seed)).astype(np.int64)) for seed in (1, 2))


def wide_print(own: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * `words` bits of distinct shingle hashes: a bit is set where more than half of them have it."""
    salts = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, len(own), 255):  # as many as a byte counts
        part = mix(own[a : a + 255, None] ^ salts)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def _set_prints(size: int, words: int):
    """Arrow batches (doc_id, t, text) -> (doc_id, t, d1, d2, prints): 128-bit digest and fingerprint of the shingle set."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(2)]
            digests = [_set_digest(x) for x in sets]
            prints = pa.array([wide_print(x, words).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), prints]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "d1", "d2", "prints"])

    return run


def _ring(words: np.ndarray, at: int) -> np.ndarray:
    """64 bits from bit `at` on of each row of words, taken as a ring of bits."""
    n = words.shape[1]
    i, s = divmod(at % (64 * n), 64)
    return words[:, i] << np.uint64(s) | words[:, (i + 1) % n] >> np.uint64(64 - s) if s else words[:, i]


def _turned(batches, turns: int, most: int):
    """For each batch, turn and block: (node, group, block, its first and last bit, print, the 64 bits after it)."""
    cuts = [round(i * TOP / (most + 1)) for i in range(most + 2)]
    for batch in batches:
        node = batch.column("node").to_numpy()
        words = batch.column("prints").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
        for turn in range(turns if len(node) else 0):
            prints, more = _ring(words, TOP * turn), _ring(words, TOP * turn + 64)
            for block, (a, b) in enumerate(zip(cuts, cuts[1:])):
                value = (prints >> np.uint64(64 - b)).astype(np.int64) & ((1 << b - a) - 1)
                yield node, (turn * (most + 1) + block << TOP) + value, (a, b), prints, more


def _group_sizes(turns: int, most: int):
    """Arrow batches (prints, node) -> (group, n), added up over a task."""

    def run(batches):
        seen: dict = {}
        for _, group, *_ in _turned(batches, turns, most):
            for g, n in zip(*(x.tolist() for x in np.unique(group, return_counts=True))):
                seen[g] = seen.get(g, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["group", "n"])

    return run


def _deal(turns: int, most: int, depths: dict):
    """Arrow batches (prints, node) -> (key, lo, hi, print, more, node), a row for each turn and block.

    Groups named in `depths` are cut into pairs of trie nodes so many bits down, by leading bits outside the block; a member
    goes to each pair its node takes part in, if the two nodes differ in at most `most` bits.
    """
    deep = pa.array(list(depths), pa.int64())
    down = np.array(list(depths.values()), np.int64)
    flips = {d: [x for x in range(1 << d) if x.bit_count() <= most] for d in {0, *depths.values()}}
    names = ["key", "lo", "hi", "print", "more", "node"]

    def parts(node, group, block, prints, more):
        if not len(down):
            zero = np.zeros(len(node), np.int32)
            yield group, zero, zero, prints.view(np.int64), more.view(np.int64), node
            return
        at = pa.compute.index_in(pa.array(group), deep).fill_null(-1).to_numpy(zero_copy_only=False)
        depth = np.where(at < 0, 0, down[at])
        free = [i for i in range(TOP) if not block[0] <= i < block[1]]
        for d in np.unique(depth).tolist():
            own = np.nonzero(depth == d)[0]
            cell = np.zeros(len(own), np.int32)
            for i in free[:d]:
                cell = cell << 1 | (prints[own] >> np.uint64(63 - i) & np.uint64(1)).astype(np.int32)
            for flip in flips[d]:
                yield group[own], np.minimum(cell, cell ^ flip), np.maximum(cell, cell ^ flip), prints[own].view(np.int64), more[own].view(np.int64), node[own]

    def run(batches):
        held, rows = [], 0
        for turned in _turned(batches, turns, most):
            for part in parts(*turned):
                held.append(part)
                rows += len(part[0])
            if rows >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    return run


def _propose(most: int, budget: int, beyond: int, flush: int):
    """Arrow batches (key, lo, hi, print, more, node) sorted by the first three -> (a, b) links that span the classes of proposed pairs."""

    def links(cells, prints, more, node):
        order = np.lexsort((prints, *cells[::-1]))
        cells, prints, more, node = [c[order] for c in cells], prints[order], more[order], node[order]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cells], axis=0)])
        kind = np.nonzero(new | np.concatenate([[True], prints[1:] != prints[:-1]]))[0]  # the first row of each print of a cell
        edge = np.concatenate([np.nonzero(new[kind])[0], [len(kind)]])
        first, last = edge[:-1], edge[1:]
        many = last - first > 1
        rest = more[kind]
        root = trie_forest(prints[kind], first[many], last[many], budget, (TOP, most), lambda i, j: np.bitwise_count(rest[i] ^ rest[j]) <= beyond)
        root = root[np.repeat(np.arange(len(kind)), np.diff(np.concatenate([kind, [len(node)]])))]
        # a class hangs on its least node, so that most cells give the same links
        least = np.full(len(kind), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        at = np.nonzero(least[root] != node)[0]
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(least[root[at]])], ["a", "b"])

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy() for c in ("key", "lo", "hi", "print", "more", "node")])
            rows += batch.num_rows
            if rows >= flush:
                *cells, prints, more, node = (np.concatenate(x) for x in zip(*held))
                new = np.nonzero(np.any([c[1:] != c[:-1] for c in cells], axis=0))[0]
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield links([c[:cut] for c in cells], prints[:cut].view(np.uint64), more[:cut].view(np.uint64), node[:cut])
                held, rows = [[x[cut:] for x in (*cells, prints, more, node)]], 0
        if held:
            *cells, prints, more, node = (np.concatenate(x) for x in zip(*held))
            yield links(cells, prints.view(np.uint64), more.view(np.uint64), node)

    return run


def _forest(flush: int):
    """Arrow batches (a, b) -> links that span the same classes, from each node to the least of its class.

    Cells of one crowd name many least nodes; what a task sees of them is joined before links are counted in joins.
    """

    def spanned(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(len(nodes))
        _unite(parent, at[: len(a)], at[len(a) :])
        up = np.nonzero(parent != np.arange(len(nodes)))[0]
        return nodes[up], nodes[parent[up]]

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            rows += batch.num_rows
            if rows >= flush:
                held = [spanned(*(np.concatenate(x) for x in zip(*held)))]
                rows = len(held[0][0])
                if 2 * rows > flush:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanned(*(np.concatenate(x) for x in zip(*held)))], ["a", "b"])

    return run


def proposed_links(prints: DataFrame, similarity: float, turns: int, most: int, split: int, n: int) -> DataFrame:
    """(a, b) links that span the classes of nodes whose fingerprints are near enough to be compared.

    prints: (node, prints), the fingerprints' words. The words are a ring of bits; a turn takes 128 of them from another place
    on and walks the first 64 as a trie: of the first `TOP` at most `most` may differ, and in each half no more than sets of
    `similarity` differ in all but rare cases. A turn's leading bits are dealt out by pigeonhole, groups of more than `split`
    in pairs of trie nodes.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi  # how often a bit of two such sets differs
    budget, beyond = (int(64 * p + k * (64 * p * (1 - p)) ** 0.5) for k in (1.6, 3))
    prints, depths = prints.where("size(prints) > 0").select("prints", "node"), {}
    if prints.count() > split:
        sizes = prints.mapInArrow(lean(_group_sizes(turns, most)), "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
        free = TOP - -(-TOP // (most + 1))
        depths = {r.group: min(free, int(np.ceil(np.log2(2 * r.n / split)))) for r in sizes.where(F.col("n") > split).collect()}
    dealt = prints.mapInArrow(lean(_deal(turns, most, depths)), "key long, lo int, hi int, print long, more long, node long")
    dealt = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = dealt.mapInArrow(lean(_propose(most, budget, beyond, 1 << 17)), "a long, b long")
    return found.repartition(n, "a").mapInArrow(lean(_forest(1 << 20)), "a long, b long").distinct()


def _set_rows(size: int):
    """Arrow batches (node, text) -> (node, shingles)."""

    def run(batches):
        for batch in batches:
            lists = pa.array([shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "shingles"])

    return run


def exact_forest(flat: np.ndarray, offsets: np.ndarray, similarity: float) -> np.ndarray:
    """Root index of every set's class, by links of a Jaccard similarity of `similarity` or more, none missed.

    Set i is flat[offsets[i] : offsets[i + 1]], without repeats. With the elements ordered by rarity, two linked sets share
    one of the first |x| - ceil(similarity |x|) + 1 of either, so only sets that do are compared; sets of the class that is
    being collected are not compared again.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    parent = np.arange(n)
    if n < 2:
        return parent
    _, element, often = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(often), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    element, owner = place[element], np.repeat(np.arange(n), sizes)
    element = element[np.lexsort((element, owner))]
    prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    early = np.arange(len(element)) - offsets[owner] < prefix[owner]
    order = np.argsort(element[early], kind="stable")
    posted, by = element[early][order], owner[early][order]
    free, left, dead = np.ones(n, bool), n, 0
    for first in range(n):
        if not free[first]:
            continue
        free[first], left, dead, stack = False, left - 1, dead + 1, [first]
        while stack and left:
            if 2 * dead > left + dead:  # postings of sets that have a class are of no more use
                live = free[by]
                posted, by, dead = posted[live], by[live], 0
            i = stack.pop()
            own = element[offsets[i] : offsets[i + 1]]
            a, b = (np.searchsorted(posted, own[: prefix[i]], side=s) for s in ("left", "right"))
            found = np.unique(np.concatenate([by[x:y] for x, y in zip(a, b) if y > x] or [by[:0]]))
            found = found[free[found]]
            found = found[np.minimum(sizes[found], sizes[i]) >= similarity * np.maximum(sizes[found], sizes[i]) - 1e-9]
            for part in np.split(found, range(1024, len(found), 1024)):
                if not len(part):
                    continue
                other = np.concatenate([element[offsets[j] : offsets[j + 1]] for j in part])
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = np.add.reduceat((own[at] == other).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                near = part[both / (sizes[part] + sizes[i] - both) >= similarity]
                free[near], parent[near], left, dead = False, first, left - len(near), dead + len(near)
                stack += near.tolist()
    return parent


def _exact_join(similarity: float, flush: int):
    """Arrow batches (key, node, shingles) sorted by key -> (a, b) links that span each key's classes."""

    def links(keys, reps, flat, offsets):
        edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))[0]
        a, b = [], []
        for x, y in zip(edge[:-1], edge[1:]):
            root = exact_forest(flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], similarity)
            at = np.nonzero(root != np.arange(y - x))[0]
            a.append(reps[x + at])
            b.append(reps[x + root[at]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def joined(held):
        keys, reps, flat, sizes = (np.concatenate(x) for x in zip(*held))
        return keys, reps, flat, np.concatenate([[0], np.cumsum(sizes)])

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("shingles")
            # copies: a view would hold the whole batch
            flat = lists.flatten().to_numpy(zero_copy_only=False).copy()
            held.append((batch.column("key").to_numpy().copy(), batch.column("node").to_numpy().copy(), flat, pa.compute.list_value_length(lists).to_numpy().astype(np.int64)))
            size += len(flat)
            if size >= flush:
                keys, reps, flat, offsets = joined(held)
                cut = int(np.searchsorted(keys, keys[-1], side="left"))
                if cut:
                    yield links(keys[:cut], reps[:cut], flat[: offsets[cut]], offsets[: cut + 1])
                held, size = [(keys[cut:], reps[cut:], flat[offsets[cut] :], np.diff(offsets[cut:]))], 0
        if held:
            yield links(*joined(held))

    return run


def _distances(flat: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Jaccard distances of sorted sets, laid end to end, from the sorted set `own`; none is empty."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), offsets[:-1])
    return 1 - both / (np.diff(offsets) + len(own) - both)


def _pivot_join(similarity: float):
    """Arrow batches (key, part, pivot, group, node, shingles) sorted by (key, part), the pivot in each -> links (a, b), and for
    every member but the pivot (node, group, its distance from the pivot, is it in the pivot's class by these links)."""

    def out(a=(), b=(), node=(), group=(), distance=(), inside=()):
        a, b, node, group = (np.asarray(x, np.int64) for x in (a, b, node, group))
        n, m = len(a), len(node)
        ints = [pa.array(np.concatenate([x, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n) for x in (a, b)]
        ints += [pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=np.arange(n + m) < n) for x in (node, group)]
        tail = [pa.array(np.concatenate([np.zeros(n), np.asarray(distance, float)])), pa.array(np.concatenate([np.zeros(n, bool), np.asarray(inside, bool)]))]
        return pa.RecordBatch.from_arrays([*ints, *tail], ["a", "b", "node", "group", "distance", "inside"])

    def close(rows):
        rows.sort(key=lambda r: not r[0])
        node = np.array([r[2] for r in rows], np.int64)
        sets = [r[3] for r in rows]
        flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        root = exact_forest(flat, offsets, similarity)
        at = np.nonzero(root != np.arange(len(root)))[0]
        yield out(node[at], node[root[at]], node[1:], [r[1] for r in rows[1:]], _distances(flat, offsets, np.sort(sets[0]))[1:], root[1:] == root[0])

    def run(batches):
        held, now = [], None
        for batch in batches:
            lists = batch.column("shingles")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]).astype(np.int64)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "pivot", "group", "node")))):
                if row[0] != now and held:
                    yield from close(held)
                    held = []
                now = row[0]
                held.append((*row[1:], flat[ends[i] : ends[i + 1]].copy()))
        if held:
            yield from close(held)

    return run


def _hot_links(hot: DataFrame, shingles: DataFrame, scratch: Scratch, similarity: float, split: int, n: int) -> DataFrame:
    """(a, b) links of groups of more than `split` sets; hot: (key, node, parts). No task holds more than a few times `split`.

    A group's members are dealt to parts, and its pivot, the set of the least node, to all of them: what is linked within a
    part or by way of the pivot is found at once, which is nearly all of a group of copies. The others are compared with the
    rest of the group, but only with sets whose distance from the pivot is near enough to their own: the Jaccard distance
    keeps the triangle inequality, so sets whose distances differ by more than 1 - similarity are no link.
    """
    pivots = hot.groupBy("key", "parts").agg(F.min("node").alias("pivot"))
    dealt = hot.join(pivots, ["key", "parts"]).where("node <> pivot").select("key", "node", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    dealt = dealt.unionByName(pivots.select("key", F.col("pivot").alias("node"), F.lit(True).alias("pivot"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part")))
    dealt = dealt.select(F.xxhash64("key", "part").alias("key"), F.col("key").alias("group"), "node", "pivot").join(shingles, "node")
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key")
    kind = "a long, b long, node long, group long, distance double, inside boolean"
    met = scratch.save(dealt.mapInArrow(lean(_pivot_join(similarity)), kind), "pivoted")
    links = met.where("a is not null").select("a", "b")
    step = (1 - similarity) * 1.001  # a little more for rounding: what is near enough lies in the next bin at most
    placed = met.where("node is not null").select(F.col("group").alias("key"), "node", "inside", F.floor(F.col("distance") / step).cast("int").alias("bin"))
    rest = placed.where("not inside")
    if not rest.take(1):
        return links
    sizes = rest.groupBy("key", "bin").agg(F.ceil(F.count("*") / split).cast("int").alias("rparts"))
    counts = hot.select("key", "parts").distinct()
    mine = rest.join(sizes, ["key", "bin"]).join(counts, "key")
    mine = mine.select("key", "node", "bin", F.pmod(F.xxhash64("node"), F.col("rparts")).cast("int").alias("rpart"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    near = placed.select("key", "node", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    near = near.join(sizes, ["key", "bin"]).join(counts, "key")
    near = near.select("key", "node", "bin", F.explode(F.expr("sequence(0, rparts - 1)")).alias("rpart"), F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")).cast("int").alias("part"))
    both = mine.unionByName(near).distinct().select(F.xxhash64("key", "bin", "rpart", "part").alias("key"), "node").distinct()
    both = both.join(shingles, "node").select("key", "node", "shingles").repartition(n, "key").sortWithinPartitions("key")
    return links.unionByName(both.mapInArrow(lean(_exact_join(similarity, 2 << 20)), "a long, b long"))


def _text_key():
    """64 bits of a text, null like empty: tells apart the texts that an id is given to."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _shingle_classes(docs: DataFrame, scratch: Scratch, similarity: float, size: int, bands: int, rows: int, split: int, group: int):
    """(known, classes, repeats): (doc_id, t, d1, d2) of every row; (d1, d2, component, stays) of every set that a row with
    an id has; do rows repeat both id and text.

    component is the smallest id of the class, and `stays` the (doc_id, t) of the row of that id that comes first.
    """
    arrow_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("t"), F.col("text"))
    words = max(2, -(-TOP * bands // 64))
    known = scratch.save(own.mapInArrow(lean(_set_prints(size, words)), "doc_id long, t long, d1 long, d2 long, prints array<long>"), "keys")
    sets = known.where("doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("least"), F.first("prints").alias("prints"))
    sets = scratch.save(sets.withColumn("node", F.monotonically_increasing_id()), "distinct")
    # sets that proposals connect are compared with each other: each set is in one such crowd at most
    arrow_batches(docs.sparkSession, 1 << 14)  # rows of a few numbers
    proposed = scratch.save(proposed_links(sets, similarity, bands, rows, group, n), "proposed")
    arrow_batches(docs.sparkSession)
    crowds = components(proposed, scratch, "crowds").withColumnRenamed("component", "key")
    parts = crowds.groupBy("key").agg(F.ceil(F.count("*") / split).cast("int").alias("parts"))
    members = scratch.save(crowds.join(parts, "key").join(sets.select("node", "least"), "node"), "members")
    # one text of each set that is compared: its row is named by id and text
    wanted = members.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.t").alias("t"))
    texts = own.join(wanted, ["doc_id", "t"])
    repeats = bool(known.where("doc_id is not null").groupBy("doc_id", "t").count().where("count > 1").take(1))
    if repeats:
        texts = texts.dropDuplicates(["node"])
    shingles = scratch.save(texts.select("node", "text").mapInArrow(lean(_set_rows(size)), "node long, shingles array<long>"), "sets")
    dealt = members.where("parts = 1").join(shingles, "node").select("key", "node", "shingles").repartition(n, "key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(lean(_exact_join(similarity, 2 << 20)), "a long, b long")
    hot = members.where("parts > 1").select("key", "node", "parts")
    if hot.take(1):
        edges = edges.unionByName(_hot_links(hot, shingles, scratch, similarity, split, n))
    found = components(scratch.save(edges, "edges"), scratch, "near")
    roots = sets.join(found.withColumnRenamed("component", "c"), "node", "left").select("d1", "d2", "least", F.coalesce("c", "node").alias("c"))
    first = roots.groupBy("c").agg(F.min("least").alias("stays"))
    classes = scratch.save(roots.join(first, "c").select("d1", "d2", F.col("stays.doc_id").alias("component"), "stays"), "classes")
    return known, classes, repeats


def near_duplicate_classes(docs: DataFrame, similarity: float = 0.8, size: int = 5, bands: int = 32, rows: int = 2, split: int = 20_000, group: int = 50_000) -> DataFrame:
    """(doc_id, component): documents linked by a Jaccard similarity of their shingle sets of `similarity` or more.

    SimHash fingerprints of the distinct shingles only propose, by trie self-joins of `bands` turns of the fingerprint with
    at most `rows` differing bits of the leading 20 (`proposed_links`); sets that proposals connect are compared element by
    element (64-bit hashes of shingles). A pair of 0.8 differs in 15 to 16 % of the bits and passes a turn with probability
    0.35 to 0.39, so all 32 miss it once in a million; with 4 shingles of 5 (19 % of the bits), five times in 10,000. Equal
    sets are one set from the start. Connected sets are dealt out in parts if more than `split` (`_hot_links`). Rows without
    an id link nothing; theirs is the component of an equal set.
    """
    known, classes, _ = _shingle_classes(docs, Scratch(docs.sparkSession), similarity, size, bands, rows, split, group)
    return known.join(classes, ["d1", "d2"], "left").select("doc_id", "component")


def _first_of_equals(rows: DataFrame, keys: list) -> DataFrame:
    """One row for each value of the key expressions: the first by all columns in order, nulls last. Combined before the shuffle."""
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    order = F.struct(*(x for c in plain for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    out = rows.groupBy(*(k.alias(f"__group{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), order).alias("__first"))
    return out.select("__first.*")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, bands: int = 32, rows: int = 2, split: int = 20_000, group: int = 50_000) -> DataFrame:
    """One row of each class stays, that of the smallest id; columns are those of `docs`.

    Rows are told apart by id and text: of an id's rows in one class the text of the least hash stays, and of rows that
    repeat both the first by their columns, nulls last. Texts of other classes stay, whatever their ids. Rows without an id
    stay, for nothing can name them.
    """
    known, classes, repeats = _shingle_classes(docs, Scratch(docs.sparkSession), similarity, size, bands, rows, split, group)
    named = known.where("doc_id is not null").join(classes, ["d1", "d2"])
    gone = named.where("doc_id <> stays.doc_id or t <> stays.t").select(F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_t")).distinct()
    own = docs["doc_id"].cast("long")
    out = docs.join(gone, (own == F.col("__gone_id")) & (_text_key() == F.col("__gone_t")), "left_anti")
    if not repeats:
        return out
    ids = F.col("doc_id").cast("long")
    return _first_of_equals(out.where("doc_id is not null"), [ids, _text_key()]).unionByName(out.where("doc_id is null"))
