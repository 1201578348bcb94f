"""Reachability over late-bound edges, cycles included.

Breadth-first by rounds: a round joins the frontier with the edges and drops what is
known.  The frontier is written to the shared folder each round, so plans stay short and
a lost executor costs one round.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import first_wins
from tessera.plans.storage import shared_table

#: Steps that one round takes before it drops what is known: more of them from a frontier
#: of few rows, where a round costs more than what it may walk twice.
HOPS, SMALL_HOPS, SMALL = 3, 8, 20_000
#: Edges that one task walks through: 4 bytes each, and at most 9 a node.
WALKED = 32_000_000


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = True) -> DataFrame:
    """(seed, node, depth) of all that the seeds reach over edges(src, dst).

    depth is the least number of edges.  A seed is its own depth 0; without
    include_seeds it appears only where a cycle returns to it.  Null ends are unresolved
    and lead nowhere.
    """
    links = shared_table(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    known = shared_table(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)), "seeds")
    frontier, rounds, depth, size = known, [known], 0, known.count()
    while max_depth is None or depth < max_depth:
        hops = SMALL_HOPS if size <= SMALL else HOPS
        hops = hops if max_depth is None else min(hops, max_depth - depth)
        seen = _union(rounds) if include_seeds else _union(rounds).where("depth > 0")
        at, steps = frontier.select("seed", "node"), []
        for hop in range(1, hops + 1):
            at = at.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
            steps.append(at.withColumn("depth", F.lit(depth + hop)))
        nearest = _union(steps).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        fresh = shared_table(nearest.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"), "round")
        depth += hops
        frontier = fresh.where(F.col("depth") == depth)
        rounds.append(fresh)
        size = frontier.count()
        if not size:
            break
        if len(rounds) > 12:  # keeps the union of rounds short
            rounds = [shared_table(_union(rounds), "visited")]
    found = _union(rounds)
    return found if include_seeds else found.where("depth > 0")


def reachable(edges: DataFrame, seeds: DataFrame, walked: int = WALKED) -> DataFrame:
    """(node) of all that the seeds(node) reach over edges(src, dst) by an edge or more; a
    seed appears where a cycle returns to it or another seed leads to it.

    However deep the graph, up to `walked` edges are walked by one task over numbers that
    stand for the nodes; more of them go by the rounds of `bfs`.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    links, start = shared_table(links, "edges"), shared_table(seeds.select("node").where("node is not null").distinct(), "seeds")
    if (total := links.count()) > walked:
        return bfs(links, start, include_seeds=False).select("node").distinct()
    names = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    names = shared_table(names.withColumn("at", F.monotonically_increasing_id()), "nodes")  # kept, as another run numbers otherwise
    part = F.shiftright("at", 33).cast("int")
    sizes = {r["part"]: r["count"] for r in names.groupBy(part.alias("part")).count().collect()}
    starts = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)), initial=0))
    names = names.select("node", (F.element_at(F.array(*map(F.lit, starts)), part + 1) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))
    ends = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = links.join(ends("src"), "src").join(ends("dst"), "dst").select("src_id", "dst_id")
    asked = start.join(names, "node").select(F.lit(None).cast("int").alias("src_id"), F.col("id").alias("dst_id"))
    nodes = starts[-1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, to, seeds, filled = np.zeros(nodes + 1, dtype=np.int32), np.empty(total, dtype=np.int32), array("i"), 0
        for b in batches:  # in order of src, seeds before all
            src, dst = b.column(0), b.column(1).to_numpy()
            seeds.extend(dst[: src.null_count].tolist())
            own, n = np.unique(src.drop_null().to_numpy(), return_counts=True)
            first[own + 1] += n.astype(np.int32)
            edges_here = len(dst) - src.null_count
            to[filled : filled + edges_here] = dst[src.null_count :]
            filled += edges_here
        seen = _walk(np.cumsum(first, out=first), to, seeds)
        for at in range(0, nodes, 100_000):
            found = np.flatnonzero(seen[at : at + 100_000]) + at
            yield pa.record_batch([pa.array(found, pa.int32())], names=["id"])

    found = numbered.union(asked).repartition(1).sortWithinPartitions("src_id").mapInArrow(walk, "id int")
    return names.join(found, "id").select("node")


def _walk(first: np.ndarray, to: np.ndarray, seeds: array) -> np.ndarray:
    """Whether the seeds reach each node by an edge or more; node i leads to the nodes
    to[first[i]:first[i + 1]].  Opens each node once, each seed once more."""
    seen, open_ = np.zeros(len(first) - 1, dtype=np.uint8), seeds
    first, to, marks = map(memoryview, (first, to, seen))  # faster than arrays one by one
    while open_:
        at = open_.pop()
        for n in to[first[at] : first[at + 1]]:
            if not marks[n]:
                marks[n] = 1
                open_.append(n)
    return seen


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst_name, dst?) with each null dst bound to all nodes(id, name) of the
    name: a name that resolves to several nodes leads to each of them."""
    known = edges.where("dst is not null").select("src", "dst")
    late = edges.where("dst is null").join(nodes, F.col("dst_name") == F.col("name")).select("src", F.col("id").alias("dst"))
    return known.union(late).distinct()


def chain_lookup(edges: DataFrame, seeds: DataFrame, owned: DataFrame, order: list[str]) -> DataFrame:
    """Per seed, the first owner on its chain: the nearest reached node that owns
    something, and of what it owns, the first row of the order."""
    reached = bfs(edges, seeds)
    hits = reached.join(owned, "node")
    return first_wins(hits, ["seed"], ["depth", "node", *order])


def members_of_closure(edges: DataFrame, seeds: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """Members of all reached nodes with their depth, nearest first."""
    hits = bfs(edges, seeds).join(members, "node")
    return hits.orderBy("depth", "node", "name").limit(limit) if limit else hits


def deep_dependencies(edges: DataFrame) -> DataFrame:
    """(node, deps): everything that each source of an edge reaches, sorted; a node of a
    cycle depends on itself no more than any other does, so it is left out."""
    seeds = edges.select(F.col("src").alias("node")).distinct()
    reached = bfs(edges, seeds, include_seeds=True).where("seed <> node")
    return reached.groupBy(F.col("seed").alias("node")).agg(F.sort_array(F.collect_set("node")).alias("deps"))


def typedef_target(names: DataFrame, aliases: DataFrame, hops: int = 4) -> DataFrame:
    """names(name) with `target`: aliases(name, base) followed up to `hops` times."""
    step = first_wins(aliases.where("base is not null and base <> name"), ["name"], ["base"]).select(F.col("name").alias("__from"), F.col("base").alias("__to"))
    out = names.withColumn("target", F.col("name"))
    for _ in range(hops):
        out = out.join(step, F.col("target") == F.col("__from"), "left").withColumn("target", F.coalesce("__to", "target")).drop("__from", "__to")
    return out
