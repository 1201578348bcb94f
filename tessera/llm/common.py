"""Session plumbing shared by the operators: tables, row streams, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import scratch, shared_path, shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of a mapInArrow input as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def arrow_batches(
    rows: Iterable[tuple], schema: pa.Schema, limit: int = 2000, weight: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `limit` rows and about `weight` bytes of text."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= limit or size >= weight:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], names: list[str], schema: pa.Schema, ddl: str) -> DataFrame:
    """mapInArrow with a generator over row tuples: memory stays at a batch or two."""
    picked = df.select(*names)

    def run(batches):
        return arrow_batches(fn(arrow_rows(batches, *names)), schema)

    return picked.mapInArrow(run, ddl)


#: A key that holds one part in so many of all edges is hot; no more than that many can
#: be, so their list is small enough to broadcast, whatever the graph.
HOT_KEYS = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row per key and, in `n`, how
    many rows of left have it; total: the sum of these.  Hot keys' rows of right are
    broadcast, so that left's rows of a hot key stay where they are; other keys meet in a
    join."""
    own = [c for c in right.columns if c not in (key, "n")]
    is_hot = F.col("n") * HOT_KEYS >= F.lit(total)
    hot = F.broadcast(right.where(is_hot).select(key, F.struct(*own).alias("__of")))
    marked = left.join(hot, key, "left")
    near = marked.where("__of is not null").select(*left.columns, "__of.*")
    return near.unionByName(marked.where("__of is null").drop("__of").join(right.where(~is_hot).drop("n"), key, how))


def _with_least(edges: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """edges with `m`, the smallest value of its key."""
    return join_counted(edges, edges.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n")), key, total)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of edges (u, v) by alternating large-star and small-star.

    Returns (node, root): one row for each node that is not the smallest of its
    component.  Runs until nothing changes; with `rounds`, raises where that many are not
    enough.  Nothing is gathered per node, and edges of a hub are not sent to one task.
    A round is two plans, with the edges of the large star as a table between them: the
    small star reads them four times, and as one plan that took much of the driver's memory.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = shared_table(ends.where("u <> v").distinct(), "links")

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen, done = digest(now), 0
    while seen[0]:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select("v", "u"))
        total = 2 * seen[0]
        near = _with_least(both, "a", "b", total).where("b > a")
        large = near.select(F.col("b").alias("u"), F.least("a", "m").alias("v")).distinct()
        path = shared_path(spark, "links")
        with scratch(spark):
            low = _with_least(shared_table(large, "stars"), "u", "v", total)
            small = low.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
            small.distinct().write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        before, seen, done = seen, digest(now), done + 1
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
