"""Registry of the retrieval engine's queries over the standard tables, each with its SQL.

documents stand for files (source for the branch, "source/lang/doc_N.txt" for the path) and, cut into line windows, for
chunks; embeddings for chunk vectors; conversations for ordered chunks of a file; events for history and cache events;
benchmark for queries, labels for relevance, page urls for paths.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the same result in DuckDB SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer files than there are cores are dealt to all cores first, larger ones stay as read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and len(df.inputFiles()) < cores else df


@contextlib.contextmanager
def shared_folder(spark: SparkSession):
    """A folder of its own in the shared one that spark.checkpoint.dir names, as a path; elsewhere only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root.removeprefix("file://") if root else None
    if root:
        os.makedirs(root, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=root) as folder:
        yield folder


def _load() -> None:
    from . import admin_queries, chunk_queries, scalar_queries, search_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
