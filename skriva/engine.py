"""The engine: load documents, build the index of a field, query it in six ways, with ranked groups of results."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import query as Q
from .operators.index import LOWER, Analyzer, document_fields, vocabulary
from .schema import NotFound, QueryLevel
from .sources import store
from .sources.loaders import current, latest
from .streaming.build import build_batch, compact_index, last_batch, live_log, live_postings, read_index

Loader = Callable[[DataFrame, str], None]
Builder = Callable[..., int]
Ranker = Callable[..., DataFrame]


class SearchEngine:
    """Documents and index under one folder: <path>/documents and <path>/index-<version>.

    Queries return a lazy DataFrame (field, token_group, group_score, doc_id, score), best group first and best document
    first. With `strict` a query without any result raises NotFound, which takes a job to find out.

    loader (docs, path), builder (as build_batch) and ranker (as operators.query.bm25) may be replaced by others of the same form.
    """

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer = LOWER, length_unit: str = "chars", strict: bool = False, loader: Loader = store.write_documents, builder: Builder = build_batch, ranker: Ranker = Q.bm25, **bm25):
        self.spark, self.path, self.analyzer, self.length_unit, self.strict, self.bm25 = spark, path.rstrip("/"), analyzer, length_unit, strict, bm25
        self.loader, self.builder, self.ranker = loader, builder, ranker
        self._kept: DataFrame | None = None

    def load(self, docs: DataFrame, doc_type: str | None = None) -> int:
        """Append documents (with doc_id), perhaps of a type; gives their number. An id that is there already is replaced for readers, who take the latest load."""
        typed = docs if "doc_type" in docs.columns else docs.withColumn("doc_type", F.lit(doc_type).cast("string"))
        folder = f"{self.path}/documents/load={time.time_ns()}"
        self.loader(typed, folder)
        return self.spark.read.parquet(folder).count()  # by the files' footers

    @property
    def stored(self) -> DataFrame:
        """All that was loaded, with the column `load`."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/documents")

    @property
    def documents(self) -> DataFrame:
        return current(self.stored).drop("load")

    def doc_types(self) -> DataFrame:
        """(doc_type, docs)."""
        return self.ids().groupBy("doc_type").agg(F.count("*").alias("docs"))

    def ids(self, doc_type: str | None = None) -> DataFrame:
        """(doc_type, doc_id) of all documents, or of one type."""
        every = latest(self.stored.select("doc_type", "doc_id", "load"), F.col("load")).select("doc_type", "doc_id")
        return every if doc_type is None else every.filter(F.col("doc_type") == doc_type)

    def document_fields(self) -> DataFrame:
        """(doc_id, fields): which fields each document has. Only their names are shuffled, not what they hold."""
        named = document_fields(self.stored.drop("doc_type"), keep=("load",))
        return latest(named, F.col("load")).select("doc_id", "fields")

    @property
    def postings(self) -> DataFrame:
        return self._kept if self._kept is not None else live_postings(self.spark, self.path)

    @property
    def stats(self) -> DataFrame:
        """(field, doc_id, field_len)."""
        return self.build_log.select("field", "doc_id", "field_len")

    @property
    def build_log(self) -> DataFrame:
        return live_log(self.spark, self.path)

    def corpus(self, field: str) -> DataFrame:
        """(n, avg_len) of a field, from one row a batch."""
        sums = read_index(self.spark, self.path, "corpus").filter(F.col("field") == field)
        return sums.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), (F.sum("chars") / F.sum("docs")).alias("avg_len"))

    def build(self, field: str, done: Callable[[int, int], None] | None = None) -> int:
        """Index the documents whose field isn't built yet or was loaded anew; gives their number, as to `done` with the batch's number. A field that doesn't exist is a ValueError."""
        self.release()
        return self.builder(self.stored, last_batch(self.spark, self.path) + 1, self.path, field, self.analyzer, self.length_unit, done)

    def compact(self, least: float = store.LIVE_RATIO, force: bool = False) -> bool:
        """Rewrite the index if too much of it is replaced; gives whether it was."""
        self.release()
        return compact_index(self.spark, self.path, least, force)

    def keep(self, field: str | None = None) -> None:
        """Keep the postings (of a field) in the executors' memory for the queries that follow, until `release`, a build or a compaction."""
        self.release()
        post = self.postings
        self._kept = (post if field is None else post.filter(F.col("field") == field)).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def fields(self) -> list[str]:
        return sorted(r.field for r in read_index(self.spark, self.path, "corpus").select("field").distinct().collect())

    def vocabulary(self) -> DataFrame:
        return vocabulary(self.postings)

    def analyze(self, text: str) -> list[str]:
        """The query's tokens, by the same expressions as the documents'."""
        return self.spark.range(1).select(self.analyzer(F.lit(text)).alias("t")).first().t

    def _ranked(self, tokens: list[str], field: str, every: bool, k: float | None = None, at_least: bool = False) -> DataFrame:
        whole, many = k is None or k >= 1 - 1e-6, len(set(tokens)) > Q.MAX_TOKENS
        options = self.bm25 | ({"corpus": self.corpus(field)} if self.bm25.get("n_scope") == "corpus" else {})
        if not whole and many:  # subsets are too many to tell apart: their documents as one group
            options["least"] = Q.absolute_k(len(set(tokens)), k) if every else 1
        groups = None if whole or many else Q.k_groups(tokens, k, at_least)
        return self.ranker(self.postings, None, tokens, groups, every, field=field, **options)

    def _run(self, text: str, field: str, every: bool, k: float | None, at_least: bool) -> DataFrame:
        tokens = self.analyze(text)
        scored = self._ranked(tokens, field, every, k, at_least)
        out = Q.ranked_groups(scored).select(F.lit(field).alias("field"), "*")
        if self.strict and out.isEmpty():
            raise NotFound(f"nothing found for {text!r} in {field}")
        return out

    def query_or(self, text: str, field: str) -> DataFrame:
        return self._run(text, field, False, None, False)

    def query_and(self, text: str, field: str) -> DataFrame:
        return self._run(text, field, True, None, False)

    def query_and_k(self, text: str, field: str, k: float) -> DataFrame:
        return self._run(text, field, True, k, False)

    def query_and_k_least(self, text: str, field: str, k: float) -> DataFrame:
        return self._run(text, field, True, k, True)

    def query_or_k(self, text: str, field: str, k: float) -> DataFrame:
        return self._run(text, field, False, k, False)

    def query_or_k_least(self, text: str, field: str, k: float) -> DataFrame:
        return self._run(text, field, False, k, True)

    def query(self, text: str, field: str, level: QueryLevel, k: float = 1.0, at_least: bool = False) -> DataFrame:
        """By level (with more than MAX_TOKENS different tokens the documents of all groups are one group): AT_OR, AT_AND, and AT_LEAST for the documents with all tokens of some group of k."""
        if level == QueryLevel.AT_OR:
            return self._run(text, field, False, k, at_least)
        return self._run(text, field, True, k, at_least or level == QueryLevel.AT_LEAST)

    def top(self, text: str, field: str, k: int, every: bool = False) -> DataFrame:
        """The k best documents, with their columns."""
        best = Q.top_k(self._ranked(self.analyze(text), field, every), k)
        found = self.stored.join(best.select("doc_id"), "doc_id", "left_semi")  # adaptive execution broadcasts it if it is small
        return best.join(current(found).drop("load"), "doc_id")

    def matching(self, text: str, field: str, least: int) -> DataFrame:
        """(doc_id, matched) of the documents with at least that many of the text's tokens, however many these are."""
        return Q.matching(self.postings, self.analyze(text), least, field)

    def fetch(self, ids: Sequence[int]) -> DataFrame:
        return current(store.fetch(self.stored, ids)).drop("load")
