"""Scoring, selection and evaluation over scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp01, overlap, rescale
from .retrieval import counter_cosine


def weighted_available(*signals: tuple[Column, float]) -> Column:
    """Mean of the signals there are; a null one gives its weight to the others; without any, 0."""
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals[1:]), F.coalesce(signals[0][0] * signals[0][1], F.lit(0.0)))
    weight = sum((F.when(s.isNull(), 0.0).otherwise(w) for s, w in signals[1:]), F.when(signals[0][0].isNull(), 0.0).otherwise(signals[0][1]))
    return F.when(weight == 0, F.lit(0.0)).otherwise(clamp01(total / weight))


def semantic(cos: Column, lexnorm: Column, floor: float = 0.25, ceiling: float = 0.85) -> Column:
    return 0.7 * rescale(cos, floor, ceiling) + 0.3 * lexnorm


def connectivity(degree: Column, most: int = 12) -> Column:
    return clamp01(F.log1p(degree) / F.log1p(F.lit(float(most))))


def recency(year: Column, reference: Column, half_life: float = 6.0) -> Column:
    """Halves every ``half_life`` years; null without a valid year."""
    return F.when(year.between(1901, 2199), F.pow(F.lit(0.5), F.greatest(F.lit(0), reference - year) / half_life))


def penalties(inactive: Column, evidence: Column, meaning: Column, matched: Column, near: Column, domain: Column, asks_area: Column, most: float = 0.35) -> dict[str, Column]:
    """Inactive .15, thin evidence (under .30) .10, superficial .08 (meaning under .35, at most one matched term, no proximity),
    domain mismatch .10 (domain 0, meaning under .55, the query has area terms); scaled to ``most`` together, each to 4 places."""
    raw = {
        "inactive": F.when(inactive, 0.15).otherwise(0.0),
        "thin": F.when(evidence < 0.30, 0.10).otherwise(0.0),
        "superficial": F.when((meaning < 0.35) & (matched <= 1) & (near <= 0), 0.08).otherwise(0.0),
        "mismatch": F.when((domain <= 0) & (meaning < 0.55) & asks_area, 0.10).otherwise(0.0),
    }
    whole = sum(list(raw.values())[1:], raw["inactive"])
    scale = F.when(whole > most, most / whole).otherwise(1.0)
    return {name: F.round(x * scale, 4) for name, x in raw.items()}


def ranked(rows: DataFrame, total: str = "total") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(total), "id")))


def diversified(rows: DataFrame, k: int, quota: int = 2, floor: float = 0.0) -> DataFrame:
    """The best ``quota`` of each kind first, then the rest by rank, ``k`` a query; ``place`` is the order of selection."""
    kept = rows.filter(F.col("total") >= floor).withColumn("in_kind", F.row_number().over(W.partitionBy("query", "kind").orderBy("rank")))
    place = F.row_number().over(W.partitionBy("query").orderBy((F.col("in_kind") > quota).cast("int"), "rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= k).drop("in_kind")


def confidence(meaning: Column, total: Column) -> Column:
    """Level of a response by its first row; without any row, 'none'."""
    return F.when(total.isNull(), "none").otherwise(_level(meaning, total))


def _level(meaning: Column, total: Column) -> Column:
    return F.when((meaning < 0.45) | (total < 0.55), "low").when(total >= 0.70, "high").otherwise("medium")


def precision(selected: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query, retrieved, labelled, hits, precision, labelled_precision) of selected (query, id, place) against labels (query, id, grade)."""
    rows = selected.filter(F.col("place") <= k).join(labels, ["query", "id"], "left")
    hit = F.count(F.when(F.col("grade") > 0, 1))
    counts = rows.groupBy("query").agg(F.count("*").alias("retrieved"), F.count("grade").alias("labelled"), hit.alias("hits"))
    return counts.withColumn("precision", F.col("hits") / F.col("retrieved")).withColumn("labelled_precision", F.when(F.col("labelled") > 0, F.col("hits") / F.col("labelled")))


def hit_rate(selected: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query, hits, expected, hit_rate, ceiling): hits among all the query's relevant items (query, id, grade), and the most that k rows allow."""
    wanted = labels.filter("grade > 0").groupBy("query").agg(F.countDistinct("id").alias("expected"))
    hits = selected.filter(F.col("place") <= k).join(labels.filter("grade > 0").select("query", "id").distinct(), ["query", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    rows = wanted.join(hits, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.withColumn("hit_rate", F.col("hits") / F.col("expected")).withColumn("ceiling", F.least(F.lit(1.0), F.lit(k) / F.col("expected")))


def ndcg(selected: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query, ndcg) of selected (query, id, place) against labels (query, id, grade).

    Gains 2^grade - 1 are discounted by log2 of the place + 1. The ideal order takes the query's best labels, found or not,
    as many as were retrieved; without any label of a grade it is 0.
    """
    rows = selected.filter(F.col("place") <= k).join(labels, ["query", "id"], "left").withColumn("gain", F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1)
    got = rows.groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("got"), F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "id"))
    ideal = labels.withColumn("at", order).filter(F.col("at") <= k).join(got.select("query", "n"), "query").filter("at <= n")
    best = ideal.groupBy("query").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("at") + 1)).alias("best"))
    return got.join(best, "query", "left").select("query", F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(F.lit(0.0)).alias("ndcg"))


def domain(asked: Column, anchors: Column, topical: Column, asked_area: Column, area: Column) -> Column:
    """Shared anchors .35, topical likeness .40, overlap of area terms .25; nothing asked is no evidence, nothing offered is 0."""
    shared = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, anchors)) / F.size(F.array_distinct(asked)))
    return weighted_available((shared, 0.35), (topical, 0.40), (F.when(F.size(asked_area) > 0, overlap(asked_area, area)), 0.25))


def method(asked: Column, found: Column, most: float = 0.75) -> Column:
    """The share of the query's methods found; for a query that names none, how much the candidate declares, up to ``most``."""
    n = F.size(found)
    declared = F.least(F.lit(most), F.when(n > 0, 0.5).otherwise(0.0) + 0.5 * F.least(F.lit(1.0), n / 3))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, found)) / F.size(F.array_distinct(asked))).otherwise(declared)


def proximity(hops: Column, decay: tuple[float, ...] = (1.0, 0.6, 0.3)) -> Column:
    """By distance; 0 if unreachable."""
    return F.when(hops.between(1, len(decay)), F.element_at(F.array(*[F.lit(x) for x in decay]), hops)).otherwise(0.0)


def graph(hops: Column, degree: Column, bridge: Column, support: Column | None = None) -> Column:
    """Proximity .45, connectivity .35, bridge .20. ``support``, the hops of an expansion that found the row, counts .75 as much as
    the distance from the query's source; the greater one is the proximity."""
    near = proximity(hops) if support is None else F.greatest(proximity(hops), 0.75 * proximity(support))
    return weighted_available((near, 0.45), (connectivity(degree), 0.35), (bridge, 0.20))


def evidence(fields: list[Column], source: list[Column], relations: Column, documents: Column) -> Column:
    """Filled fields .50, known parts of the provenance .20, relations with provenance (three suffice) .20, documents .10."""

    def filled(cells: list[Column]) -> Column:
        return sum((F.coalesce((F.trim(c.cast("string")) != "").cast("int"), F.lit(0)) for c in cells), F.lit(0)) / len(cells)

    return weighted_available((filled(fields), 0.50), (filled(source), 0.20), (F.least(F.lit(1.0), relations / 3), 0.20), (documents, 0.10))


def actionable(status: Column, scores: dict[str, float], year: Column, reference: Column, people: Column, outputs: Column, resources: Column, unknown: float = 0.70) -> Column:
    """Status .35 (from ``scores``, others ``unknown``), recency .25, people .20, outputs .10, resources .10; nulls give their weight away."""
    known = F.lit(unknown)  # blank and unknown ones
    for name, score in scores.items():
        known = F.when(status == name, score).otherwise(known)
    return weighted_available((known, 0.35), (recency(year, reference), 0.25), (people, 0.20), (outputs, 0.10), (resources, 0.10))


def redundancy(rows: DataFrame, counts: DataFrame, window: int = 50, least: float = 0.92, penalty: float = 0.06) -> DataFrame:
    """Ranked rows ranked anew after rows like a better one of their kind in the query's first ``window`` lose ``penalty``; adds redundancy.

    ``counts`` has (id, term, tf) of the rows in the window; likeness is the cosine of the counts. A duplicate still counts for
    those behind it. At most window * (window - 1) / 2 pairs a query.
    """
    top = rows.filter(F.col("rank") <= window).select("query", "kind", "id", "rank")
    better = top.select("query", "kind", F.col("rank").alias("ahead"), F.col("id").alias("other"))
    pairs = top.join(better, ["query", "kind"]).filter("ahead < rank")
    alike = counter_cosine(counts, pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()).filter(F.col("cosine") >= least)
    like = pairs.join(alike.select(F.col("a").alias("id"), F.col("b").alias("other")), ["id", "other"]).select("query", "id", F.lit(penalty).alias("lost")).distinct()
    found = rows.join(like, ["query", "id"], "left")
    lost = F.coalesce("lost", F.lit(0.0))
    cut = found.withColumn("redundancy", lost).withColumn("total", F.round(F.greatest(F.lit(0.0), F.col("total") - lost), 6)).drop("lost")
    return ranked(cut.drop("rank"))


def relation(kind: Column, names: dict[str, str], completed: Column, compared: Column, others: Column, graph_only: Column) -> Column:
    """Name of the inferred relation: by kind; ANTECEDENT if completed; METHOD if that signal is at least .60 and .25 ahead; GRAPH last."""
    by_kind = F.lit("RELATED_TO")
    for key, name in names.items():
        by_kind = F.when(kind == key, name).otherwise(by_kind)
    return F.when(graph_only, "CONNECTED_TO").when((compared >= 0.60) & (compared - others >= 0.25), "SHARES_METHOD").when(completed, "ANTECEDENT_OF").otherwise(by_kind)


def discarded(rows: DataFrame, selected: DataFrame, limit: int = 3) -> DataFrame:
    """The max(1, limit - 1) best rows that were not selected and the query's worst of them, each with a reason."""
    missed = rows.join(selected.select("query", "id"), ["query", "id"], "left_anti")
    near = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    far = F.row_number().over(W.partitionBy("query").orderBy(F.desc("rank")))
    shown = missed.withColumn("near", near).withColumn("far", far).filter((F.col("near") <= max(1, limit - 1)) | (F.col("far") == 1))
    reason = F.when(F.col("penalty") > 0, "penalised").when(F.col("total") < 0.3, "low total").otherwise("behind the selection")
    return shown.withColumn("reason", reason).drop("near", "far")


def evidence_items(fields: DataFrame, terms: DataFrame, most: int = 4) -> DataFrame:
    """The ``most`` fields (query, id, position, field, words) with the most of the query's ``terms`` (query, term); ties by position."""
    asked = terms.groupBy("query").agg(F.collect_set("term").alias("asked"))
    rows = fields.join(asked, "query").withColumn("hits", F.size(F.array_intersect("words", "asked"))).drop("asked", "words")
    order = F.row_number().over(W.partitionBy("query", "id").orderBy(F.desc("hits"), "position"))
    return rows.withColumn("item", order).filter(F.col("item") <= most)


def opportunities(summary: DataFrame, rules: list[tuple[str, dict[str, float]]], fallback: str) -> DataFrame:
    """(query, rule, number, priority): the rules, in order, whose every requirement the query's summary meets, else the fallback.

    A requirement is a column of ``summary`` and its least value; a column that is not there raises.
    """
    unknown = {c for _, needs in rules for c in needs} - set(summary.columns)
    if unknown:
        raise ValueError(f"unknown requirements: {sorted(unknown)}")
    met = []
    for name, needs in rules:
        all_met = F.lit(True)
        for column, least in needs.items():
            all_met &= F.coalesce(F.col(column) >= least, F.lit(False))
        met.append(F.when(all_met, name))
    found = F.filter(F.array(*met), lambda x: x.isNotNull())
    named = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))
    priority = F.when(F.col("top") >= 0.60, "HIGH").when(F.col("top") >= 0.40, "MEDIUM").otherwise("LOW")
    return summary.select("query", priority.alias("priority"), F.posexplode(named).alias("at", "rule")).select("query", "rule", (F.col("at") + 1).alias("number"), "priority")


def explanation(kind: Column, meaning: Column, proof: Column, total: Column, level: Column) -> Column:
    """One plain sentence on a ranked row."""

    def percent(x: Column) -> Column:
        return F.round(x * 100, 0).cast("int")

    return F.format_string("%s: total %d%%, meaning %d%%, evidence %d%%; confidence %s", kind, percent(total), percent(meaning), percent(proof), level)
