"""Exact top-k by inner product as a Voronoi join: cells around pivots, bounds from summaries, replication, local search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, save

#: Pivots, rows of a data block, queries that meet a block in one task: bounds on what one task holds.
PIVOTS, BLOCK, TOGETHER = 24, 20_000, 20_000
#: Partial sums below this are exact in doubles.
EXACT = float(1 << 53)


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(256 * x) of each component. Null vectors, ids or components, NaN and infinities take no part.

    A component that a long can't hold raises.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, fine)
    whole = lambda e: F.when(F.abs(e * 256) < float(1 << 62), F.floor(e * 256).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))
    return embeddings.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of a matrix of longs; a shorter vector's missing components are zero."""
    if isinstance(vectors, pa.Array):
        offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        if len(sizes) and (sizes == width).all():
            return flat[offsets[0] : offsets[-1]].reshape(-1, width)
        vectors = [flat[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of longs, exact: in doubles where no partial sum can be inexact, else in integers."""
    a, b = (np.abs(m.astype(np.float64)).max(initial=0.0) for m in (y, x))
    if a * b * max(1, y.shape[1]) < EXACT:
        return y.astype(np.float64) @ x.astype(np.float64).T
    return y.astype(object) @ x.astype(object).T


def cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell``, the nearest pivot (Euclidean), ``dist`` to it and ``norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            width = max([pivots.shape[1], *np.diff(v.offsets.to_numpy()).tolist()])
            x, p = _matrix(v, width).astype(np.float64), _matrix(pivots, width).astype(np.float64)
            square = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)
            cell = square.argmin(1)
            dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))], names=[*b.schema.names, "cell", "dist", "norm"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{fields}, cell int, dist double, norm double")


def thresholds(pivots: np.ndarray, radius: dict[int, float], near: dict[int, list[tuple[float, int]]], k: int) -> dict[int, float]:
    """For each cell of queries a score that every query of it reaches with k data rows of other ids than its own.

    For a query within u of pivot g and a data row at distance d from pivot c, the score is at least
    g.c - u |c| - (|g| + u) d. ``near`` has each cell's k + 1 smallest distances of different ids, as (distance, id), which give as
    many such rows; the (k + 1)-th best id counts, for one of them may be the query's own. Without enough ids there is no bound.
    """
    norm = np.sqrt((pivots**2).sum(1))
    out = {}
    for g, u in radius.items():
        best: dict[int, float] = {}
        for c, found in near.items():
            for d, i in found:
                best[i] = max(best.get(i, -np.inf), float(pivots[g] @ pivots[c]) - u * norm[c] - (norm[g] + u) * d)
        lows = sorted(best.values(), reverse=True)
        out[g] = lows[k] if len(lows) > k else -np.inf
    return out


def gatherings(queries: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Groups put together until they have about ``most`` queries, larger ones split: lists of (group, part, of so many parts)."""
    out, held = [], most
    for g, n in sorted(queries.items()):
        parts = max(1, -(-n // most))
        for part in range(parts):
            if held + n // parts > most:
                out.append([])
                held = 0
            out[-1].append((g, part, parts))
            held += n // parts
    return out


def top_k(base: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """The ``k`` best scores of each row for which ``queries`` holds, against all rows but those with its vec_id.

    ``base`` is a saved table (vec_id, v). Queries and data are grouped by the nearest of PIVOTS pivots (the rows of
    smallest id hash). Summaries per cell (radius of the queries, the smallest distances of k + 1 ids of the data) bound each
    group's k-th best score from below; a data row x is needed by a group only if pivot.x + radius |x| reaches that bound. Groups
    gather until they have about TOGETHER queries, and a row goes once to each gathering that holds a group which needs it, with the list of
    those groups; in it rows lie in blocks of about BLOCK by a hash of their ids, whatever their cell holds. A block and a
    gathering are solved group by group with matrix products and give k rows a query at most, merged by rank. Equal vectors of
    one vec_id are one query; repeated rows are candidates each. Shorter vectors count as padded with zeros. Scores are exact (see
    ``products``); one that a long can't hold raises.
    Ties go to the smaller vec_id. Empty table: no rows.
    """
    chosen = base.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(PIVOTS).collect()
    if not chosen:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _matrix([r["v"] for r in chosen], max(1, max(len(r["v"]) for r in chosen)))
    at = save(cells(base.withColumn("is_query", queries), pivots))
    width = at.agg(F.max(F.size("v"))).first()[0]
    pivots = _matrix(pivots, max(width, pivots.shape[1])).astype(np.float64)
    stats = at.groupBy("cell").agg(F.max(F.when(F.col("is_query"), F.col("dist"))).alias("radius"), F.count(F.when(F.col("is_query"), 1)).alias("queries"), F.count("*").alias("rows"))
    ids = at.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist"))
    nearest = ids.select("cell", "vec_id", "dist", F.row_number().over(W.partitionBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("dist", "vec_id")).alias("i")).filter(F.col("i") <= k + 1)
    nearest = nearest.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))), 1, k + 1).alias("near"))  # 64 (k + 1) values a cell at most
    stats = {r["cell"]: r for r in stats.collect()}
    near = {r["cell"]: [(x["dist"], x["vec_id"]) for x in r["near"]] for r in nearest.collect()}
    radius = {g: r["radius"] for g, r in stats.items() if r["queries"]}
    low = thresholds(pivots, radius, near, k)
    groups = sorted(radius)
    place = {g: i for i, g in enumerate(groups)}
    blocks = max(1, -(-sum(r["rows"] for r in stats.values()) // BLOCK))
    sets = gatherings({g: stats[g]["queries"] for g in groups}, TOGETHER)
    least = np.array([low[g] for g in groups])
    around = np.array([radius[g] for g in groups])
    member = np.zeros((max(1, len(groups)), max(1, len(sets))), bool)
    for i, held in enumerate(sets):
        member[[place[g] for g, _, _ in held], i] = True

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            x = _matrix(v, pivots.shape[1]).astype(np.float64)
            high = x @ pivots[groups].T + around[None, :] * np.sqrt((x * x).sum(1))[:, None]
            needs = high + 1e-6 * np.abs(high) + 1 >= least[None, :]
            row, to = np.nonzero(needs @ member[: len(groups)])
            wanted = needs[row] & member[: len(groups)].T[to]
            flat = pa.array(np.nonzero(wanted)[1].astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], wanted.sum(1).cumsum()]).astype(np.int32)), flat)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), v.take(take), pa.array(to.astype(np.int32)), lists], names=["vec_id", "v", "gathering", "needed_by"])

    data = map_arrow(at.select("vec_id", "v"), send, "vec_id long, v array<long>, gathering int, needed_by array<int>")
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    facts = [(g, place[g], parts, part, i) for i, held in enumerate(sets) for g, part, parts in held]
    where = base.sparkSession.createDataFrame(facts, "cell int, grp int, parts int, part int, gathering int")  # a row for each group and part
    asked = at.filter("is_query").select("vec_id", "v", "cell").distinct().join(F.broadcast(where), "cell")
    asked = asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")) == F.col("part")).select("vec_id", "v", "grp", "gathering")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            d = d.sort_values("vec_id", kind="stable")
            wide = max(max(map(len, d["v"])), max(map(len, q["v"])), 1)
            ids, all_x = d["vec_id"].to_numpy(), _matrix(list(d["v"]), wide)
            sizes = d["needed_by"].map(len).to_numpy()
            needed = np.zeros((len(d), len(groups)), bool)
            needed[np.repeat(np.arange(len(d)), sizes), np.concatenate(list(d["needed_by"])).astype(np.int64)] = True
            for group, asking in q.groupby("grp"):
                mine = np.flatnonzero(needed[:, group])
                x, near_ids, own = all_x[mine], ids[mine], asking["vec_id"].to_numpy()
                y = _matrix(list(asking["v"]), wide)
                for i in range(0, len(y), 64):
                    scores = products(y[i : i + 64], x)
                    for j, s in enumerate(scores):
                        keep = np.flatnonzero(near_ids != own[i + j])
                        s = s[keep]
                        if len(s) > k:
                            kth = np.partition(s, len(s) - k)[len(s) - k]
                            best = np.flatnonzero(s >= kth)
                        else:
                            best = np.arange(len(s))
                        best = best[np.argsort(-s[best], kind="stable")[:k]]  # ids ascend, so ties go to the smaller
                        out.append(pd.DataFrame({"query_id": own[i + j], "qv": [asking["v"].iat[i + j]] * len(best), "vec_id": near_ids[keep[best]], "score": s[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "qv": [], "vec_id": [], "score": []})

    keys = ["gathering", "block"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, qv array<long>, vec_id long, score long")
    found = found.select("query_id", F.xxhash64("qv").alias("q"), "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50; nulls, ties, repeats and empty tables as in ``quantized`` and ``top_k``."""
    base = save(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(base, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM b q JOIN b d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
