"""Embedding near-duplicates by product quantisation.

Equal vectors of a label are one class with a multiplicity. Unit vectors go to coarse inverted lists; their residuals are
coded by subspace. Two vectors of cosine >= c lie within r = sqrt(2 - 2c) of each other, and a vector within r of x can
only be in a list whose bisector with x's own list is within r of x: those lists are the probes, so none that matters is
left out. In a list, asymmetric distances (a table lookup for each subspace code) plus the stored quantisation error give
a lower bound of the distance; what it does not rule out is compared exactly, by cosine in double precision. Recall is
therefore that of an exhaustive comparison (tests measure it).

The index is fitted on vectors of at most `sample` numbers in all, those of the smallest hashes; every vector is indexed. A list of one label
with more than `block` vectors is cut into blocks, and pairs of blocks are tasks of their own. Tasks return link counts and
a spanning forest of the links, never the links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link
with nothing; vectors of different lengths do not link; rows that repeat a vector link with each other; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean
from .simhash import _unite

#: Numbers in the sample that an index is fitted on: 65,536 vectors of 64 dimensions, fewer of more.
SAMPLE, BLOCK, CELL = 1 << 22, 2048, 512
SUBSPACES, CODES = 8, 64
EPS = 1e-7


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = np.concatenate([np.argmin((centres**2).sum(1) - 2 * part @ centres.T, axis=1) for part in np.array_split(points, max(1, len(points) * k // (1 << 24)))])
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=points[:, d], minlength=k) for d in range(points.shape[1])], axis=1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


class Index:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = _unit(sample)
        self.centres = kmeans(unit, lists)
        own = np.argmin(self.squares(unit), axis=1)
        residual = unit - self.centres[own]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, c], CODES, 6) for c in self.cuts]

    def squares(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)

    def place(self, x: np.ndarray, radius: float):
        """(own list, probes above it as (row, list), codes, quantisation errors) of unit vectors."""
        square = self.squares(x)
        own = np.argmin(square, axis=1)
        near = square[np.arange(len(x)), own]
        gap = np.sqrt(self.squares(self.centres[own]))
        reach = square - near[:, None] <= 2 * (radius + EPS) * gap + EPS
        reach &= np.arange(len(self.centres))[None] > own[:, None]
        residual = x - self.centres[own]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        back = np.empty_like(residual)
        for i, (c, book) in enumerate(zip(self.cuts, self.books)):
            part = residual[:, c]
            codes[:, i] = np.argmin((book**2).sum(1) - 2 * part @ book.T, axis=1)
            back[:, c] = book[codes[:, i]]
        return own, np.nonzero(reach), codes, np.sqrt(((residual - back) ** 2).sum(1))

    def tables(self, x: np.ndarray, number: int) -> list[np.ndarray]:
        """Squared distances of each query's residual in list `number` to the codes of each subspace."""
        residual = x - self.centres[number]
        return [((residual[:, None, c] - book[None]) ** 2).sum(-1) for c, book in zip(self.cuts, self.books)]


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would not be finite, or zero
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place_rows(indexes: dict[int, Index], radius: float):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for a in range(0, part.num_rows, 2048):
                    rows = part.slice(a, 2048)
                    own, (row, other), codes, errors = indexes[dim].place(_unit(_vectors(rows.column("embedding"), dim)), radius)
                    at = np.concatenate([np.arange(len(own)), row])
                    number = np.concatenate([own, other]).astype(np.int32)
                    query = np.concatenate([np.zeros(len(own), bool), np.ones(len(row), bool)])
                    base = rows.take(pa.array(at))
                    code = pa.array([c.tobytes() for c in codes]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*base.columns, pa.array(number), pa.array(query), code, pa.array(errors[at])], [*base.schema.names, "list", "query", "code", "error"]
                    )

    return run


def _compare(indexes: dict[int, Index], cosine: float, radius: float):
    """Groups of rows (key, side) -> (rep, n, root): links of each vector in the group, and a forest of them."""

    def group(rows: pa.Table):
        dim, number = rows.column("dim")[0].as_py(), rows.column("list")[0].as_py()
        index, x = indexes[dim], _unit(_vectors(rows.column("embedding").combine_chunks(), dim))
        side, mult = rows.column("side").to_numpy(), rows.column("mult").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        error, parent, links = rows.column("error").to_numpy(), np.arange(len(x)), np.zeros(len(x), np.int64)
        stored = np.nonzero(side != 2)[0]
        # side 0: a block against itself; 1: the other block or the queries; 2: queries alone
        left = np.nonzero(side == 0)[0] if (side == 0).all() else np.nonzero(side != 0)[0]
        right = stored[side[stored] == 0]
        itself = (side == 0).all()
        for a in range(0, len(left), 512):
            i = left[a : a + 512]
            tables = index.tables(x[i], number)
            far = np.zeros((len(i), len(right)))
            for t, c in zip(tables, codes[right].T):
                far += t[:, c]
            p, q = np.nonzero(np.sqrt(far) <= radius + error[right] + 1e-6)
            p, q = i[p], right[q]
            if itself:
                keep = p < q
                p, q = p[keep], q[keep]
            for b in range(0, len(p), 1 << 17):
                u, v = p[b : b + (1 << 17)], q[b : b + (1 << 17)]
                ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[ok], v[ok]
                np.add.at(links, u, mult[v])
                np.add.at(links, v, mult[u])
                _unite(parent, u, v)
        at = np.nonzero(links)[0]
        reps = rows.column("rep").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(links[at]), pa.array(reps[parent[at]])], ["rep", "n", "root"])

    def run(batches):
        held: list = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column("key")[0].as_py() != keys[a]:
                    yield group(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.98, lists: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    # single precision travels as it is, anything else in double
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    good = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(good), F.lit(False)))
    rows = rows.select("vec_id", "embedding", "label", "ok", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2"))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = scratch.save(classes.withColumn("dim", F.size("embedding")), "classes")
    indexes: dict[int, Index] = {}
    for dim, n, labels in sorted(map(tuple, classes.groupBy("dim").agg(F.count("*"), F.approx_count_distinct("label")).collect())):
        some = classes.where(F.col("dim") == dim).select("embedding").orderBy("h1", "h2").limit(max(256, sample // dim)).toArrow()
        # about CELL vectors to a label's list: more lists mean more probes, each a copy of the vector
        k = lists or min(4096, max(1, n // (max(1, labels) * CELL)))
        indexes[dim] = Index(_vectors(some.column(0).combine_chunks(), dim), min(k, max(1, some.num_rows // 16)))
    found = None
    if indexes:
        fields = f"rep long, mult long, embedding {kind}, label string, dim int, list int, query boolean, code binary, error double"
        placed = classes.select("rep", "mult", "embedding", F.col("label").cast("string").alias("label"), "dim").mapInArrow(lean(_place_rows(indexes, radius)), fields)
        placed = scratch.save(placed, "placed")
        cells = placed.groupBy("label", "dim", "list").agg(F.count_if(~F.col("query")).alias("s"), F.count_if(F.col("query")).alias("q"))
        cells = cells.select("label", "dim", "list", F.ceil(F.col("s") / block).cast("int").alias("ns"), F.ceil(F.col("q") / block).cast("int").alias("nq"))
        both = placed.join(cells, ["label", "dim", "list"]).where("ns > 0")
        own = "cast(pmod(xxhash64(rep), if(query, nq, ns)) as int)"
        # (kind, left block, right block, side): stored against stored, and queries against stored
        stored = f"""transform(sequence(0, ns - 1), j -> named_struct('kind', 0, 'a', least(j, own), 'b', greatest(j, own), 'side', if(own >= j, 0, 1)))"""
        probed = "if(nq > 0, transform(sequence(0, nq - 1), j -> named_struct('kind', 1, 'a', own, 'b', j, 'side', 0)), array())"
        asked = "transform(sequence(0, ns - 1), j -> named_struct('kind', 1, 'a', j, 'b', own, 'side', 2))"
        tasks = both.withColumn("own", F.expr(own)).withColumn("task", F.explode(F.expr(f"if(query, {asked}, concat({stored}, {probed}))")))
        tasks = tasks.select(F.xxhash64("label", "dim", "list", "task.kind", "task.a", "task.b").alias("key"), F.col("task.side").alias("side"), "rep", "mult", "embedding", "dim", "list", "code", "error")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = tasks.repartition(n, "key").sortWithinPartitions("key")
        found = scratch.save(tasks.mapInArrow(lean(_compare(indexes, cosine, radius)), "rep long, n long, root long"), "found")
    if found is None:
        found = spark.createDataFrame([], "rep long, n long, root long")
    nodes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "pq")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.select("h1", "h2", "rep", "mult").join(links, "rep", "left").join(nodes, F.col("rep") == F.col("node"), "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.where("ok").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", F.col("c").alias("component_id"))
    rest = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
