"""The engine as an object: search, evidence, entities, expansion, checks and export over one graph and one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import graph, index, retrieval, scoring, validation
from .sources.tables import EDGES, NODES, edges, nodes, table
from .storage import save


class Engine:
    """Methods return DataFrames; the index is built when a search first asks for it; unknown types and identifiers of a wrong form raise."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes, self.edges = nodes(spark, sf_dir), edges(spark, sf_dir)
        self.documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "text")

    @property
    def index(self) -> index.Index:
        """Built when first asked for."""
        return index.index_of(self.documents)

    def search(self, asked: str, kinds: tuple[str, ...] = (), limit: int = 5, quota: int = 2) -> DataFrame:
        """(query, id, kind, score, rank, place, terms): BM25 of the whole corpus, the quota of each kind first if several are asked for."""
        if not asked.strip() or not 1 <= limit <= 50:
            raise ValueError("a query needs a text and a limit from 1 to 50")
        query = self.spark.createDataFrame([(1, asked)], "query int, text string")
        terms = retrieval.query_terms(query)
        parts = save(retrieval.bm25_terms(self.index, terms))
        rows = parts.groupBy("query", "id", "kind").agg(F.sum("part").alias("score")).filter("score > 0")
        if kinds:
            rows = rows.filter(F.col("kind").isin(*kinds))
        best = retrieval.top_per_kind(rows.withColumn("total", F.round("score", 6)).drop("score"), limit, "total").drop("rank")  # no more of a kind can be chosen
        place = scoring.diversified(scoring.ranked(best), limit, quota if len(kinds) != 1 else limit)
        found = parts.join(F.broadcast(place.select("query", "id")), ["query", "id"], "left_semi")
        found = found.groupBy("query", "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("k"), "term"))).alias("t"))
        return place.join(found, ["query", "id"]).select("query", "id", "kind", F.col("total").alias("score"), "rank", "place", F.concat_ws("|", F.col("t.term")).alias("terms"))

    def entity(self, label: str, identifier: str) -> DataFrame:
        """The node with its degree: one row, or none."""
        one = self.nodes_of(label).filter(F.col("id") == identifier)
        return one.join(graph.degree(self.edges).filter(F.col("id") == identifier), "id", "left")

    def nodes_of(self, label: str) -> DataFrame:
        if label not in NODES:
            raise ValueError(f"unknown type: {label}")
        return nodes(self.spark, self.sf_dir, (label,))

    def expand(self, identifiers: list[str]) -> DataFrame:
        """Everything within two hops, each with its shortest path; earlier identifiers win ties."""
        rows = [(i, at) for at, i in enumerate(dict.fromkeys(identifiers), 1)]
        return graph.expand(graph.steps_of(self.edges), self.spark.createDataFrame(rows, "id string, seed_rank int"))

    def guard(self, sentence: str) -> DataFrame:
        """Identifiers that the sentence cites and the graph does not have."""
        row = self.spark.createDataFrame([(1, sentence)], "row int, sentence string")
        return validation.unknown_ids(row, "row", text.canonical_ids(F.col("sentence")), self.nodes).select("unknown")

    def validate(self) -> DataFrame:
        """(rel, src, dst, end): edges one of whose ends is not a node, for every kind of edge."""
        known = self.nodes.select("id")
        kept = self.edges.select("rel", "src", "dst")
        ends = [kept.join(known.withColumnRenamed("id", end), end, "left_anti").select("rel", "src", "dst", F.lit(end).alias("end")) for end in ("src", "dst")]
        return ends[0].unionByName(ends[1])

    def export(self, path: str) -> None:
        """Write nodes and edges as JSON lines below ``path``, edges by kind."""
        self.nodes.write.mode("errorifexists").json(f"{path}/nodes")
        self.edges.write.mode("errorifexists").partitionBy("rel").json(f"{path}/edges")

    def health(self) -> DataFrame:
        """(name, n) of the kinds of nodes and edges."""
        parts = [self.nodes.groupBy(F.col("label").alias("name")), self.edges.groupBy(F.col("rel").alias("name"))]
        counts = parts[0].count().unionByName(parts[1].count()).withColumnRenamed("count", "n")
        names = self.spark.createDataFrame([(x,) for x in (*NODES, *EDGES)], "name string")
        return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
