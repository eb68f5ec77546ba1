"""Graph operators on edges (src, rel, dst): bounded walks from seeds by joins.

Walks read the edges as adjacency, both directions and each pair once; ``near`` takes that as a table saved before, or makes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import save


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (id, rel, other, direction)."""
    out = edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other"), F.lit("OUTGOING").alias("direction"))
    back = edges.select(F.col("dst").alias("id"), "rel", F.col("src").alias("other"), F.lit("INCOMING").alias("direction"))
    return out.unionByName(back)


def merge_edges(rows: DataFrame, keys: list[str], order: list[Column], values: list[str], source: list[Column] | None = None) -> DataFrame:
    """One edge per key: the last row's values and the number of rows behind it.

    With ``source``, also ``sources``: the distinct provenance of those rows, each its parts joined by ':', in order.
    """
    last = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *values)
    more = [F.array_sort(F.collect_set(F.concat_ws(":", *source))).alias("sources")] if source else []
    merged = rows.groupBy(*keys).agg(F.max(last).alias("last"), F.count("*").alias("provenance"), *more)
    return merged.select(*keys, *[F.col(f"last.{v}").alias(v) for v in values], "provenance", *(["sources"] if source else []))


def degree(edges: DataFrame) -> DataFrame:
    """Incident edges per node; parallel edges count each."""
    return adjacency(edges).groupBy("id").agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, rel, direction, other, label, title) of the seeds' neighbours; dangling edges are skipped."""
    near = adjacency(edges).join(seeds.select("id"), "id", "left_semi")
    known = nodes.select(F.col("id").alias("other"), "label", "title")
    return near.join(known, "other").select("id", "rel", "direction", "other", "label", "title")


def near_of(edges: DataFrame) -> DataFrame:
    """(id, other): who is next to whom, each pair once."""
    return adjacency(edges).select("id", "other").distinct()


def walk(edges: DataFrame, seeds: DataFrame, hops: int, near: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(seed, id, hops): the shortest undirected distance, up to ``hops``, the seed itself included at 0.

    Each hop's frontier is saved, so a hop neither repeats those before it nor reads more than the adjacency once. With ``few``,
    for graphs whose degrees are bounded, repeating a hop costs less than a table and nothing is saved.
    """
    near = save(near_of(edges)) if near is None else near
    seen = front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        step = front.join(near, "id").select("seed", F.col("other").alias("id")).distinct()
        front = step.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop))
        front = front if few else save(front)
        seen = seen.unionByName(front)
    return seen


def related(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, label: str, limit: int = 50, near: DataFrame | None = None) -> DataFrame:
    """(seed, id, hops): nodes of the label one hop away or, for seeds without any, exactly two hops away; ids ascend to the limit."""
    found = walk(edges, seeds, 2, near).filter("hops > 0").join(nodes.filter(F.col("label") == label).select("id"), "id", "left_semi")
    nearest = found.withColumn("least", F.min("hops").over(W.partitionBy("seed"))).filter(F.col("hops") == F.col("least"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("id"))
    return nearest.withColumn("at", rank).filter(F.col("at") <= limit).select("seed", "id", "hops")


def induced(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The distinct edges with both ends within ``hops`` of the seeds."""
    inside = walk(edges, seeds, hops).select("id").distinct()
    kept = edges.select("src", "rel", "dst").distinct()
    return kept.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")


def steps_of(edges: DataFrame) -> DataFrame:
    """(id, other, step): one step of a path from id to other, as text; parallel edges give it several times."""
    arrow = F.when(F.col("direction") == "OUTGOING", F.concat(F.lit(" -"), "rel", F.lit("-> "))).otherwise(F.concat(F.lit(" <-"), "rel", F.lit("- ")))
    return adjacency(edges).select("id", "other", F.concat(arrow, "other").alias("step"))


def expand(steps: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, hops, seed, path) of all nodes within two ``steps`` of the seeds (*by, id, seed_rank), each by its shortest path.

    Ties go to the seed of the lower rank and then to the smaller path. A seed can be found by going out and back. ``by`` names
    columns, such as the query, whose values are expanded apart. Steps are read twice, past the seeds and past the first hop, both
    saved so that their sizes are known, and are not shuffled while those are small; a step that is there several times changes nothing.
    """
    one = save(seeds).join(steps, "id").select(*by, F.col("other").alias("id"), F.lit(1).alias("hops"), "seed_rank", F.col("id").alias("seed"), F.concat("id", "step").alias("path"))
    one = save(one.distinct())
    two = one.join(steps, "id").select(*by, F.col("other").alias("id"), F.lit(2).alias("hops"), "seed_rank", "seed", F.concat("path", "step").alias("path"))
    best = one.unionByName(two).groupBy(*by, "id").agg(F.min(F.struct("hops", "seed_rank", "path", "seed")).alias("b"))
    return best.select(*by, "id", "b.hops", "b.seed", "b.path")


def shared_neighbors(edges: DataFrame, pairs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(seed, id, shared, either, mine): the pair's common neighbours, all their neighbours, and the seed's."""
    near = save(near_of(edges)) if near is None else near
    mine = near.join(pairs.select(F.col("seed").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("seed"), "other")
    theirs = near.join(pairs.select("id").distinct(), "id", "left_semi")
    common = pairs.select("seed", "id").join(mine, "seed").join(theirs, ["id", "other"]).groupBy("seed", "id").agg(F.count("*").alias("shared"))
    sizes = theirs.groupBy("id").agg(F.count("*").alias("n"))
    own = mine.groupBy("seed").agg(F.count("*").alias("m"))
    rows = pairs.select("seed", "id").join(sizes, "id", "left").join(own, "seed", "left").join(common, ["seed", "id"], "left")
    shared = F.coalesce("shared", F.lit(0))
    return rows.select("seed", "id", shared.alias("shared"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) - shared).alias("either"), F.coalesce("m", F.lit(0)).alias("mine"))
