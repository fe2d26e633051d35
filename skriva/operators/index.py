"""The inverted index as tables: postings, document statistics, vocabulary, build log.

Postings are aggregated by (field, token, doc_id), so that a frequent token is spread over all tasks. Only the
stored form is arranged by token, in sorted files, whose statistics prune a lookup to a few row groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as default

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ALIASES
from ..session import TASK_BYTES, stored_bytes, tasks
from .filters import TokenFilter, chain, lowercase
from .tokenize import chinese_segments, english


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer, and filters in order. A segmentor (Column -> array<string>) takes the tokenizer's place."""

    language: str = "en"
    filters: Sequence[TokenFilter] = default(default_factory=tuple)
    strip_separator: bool = False
    segmentor: TokenFilter | None = None

    def __call__(self, text: Column) -> Column:
        if self.segmentor is not None:
            tokens = self.segmentor(text)
        elif self.language == "zh":
            from .filters import chinese_lines, chinese_stop_words

            tokens = chinese_stop_words(chinese_lines(chinese_segments(text)))
        else:
            tokens = english(text, self.strip_separator)
        return chain(tokens, *self.filters)


#: The plain search analyzer: lower-cased raw tokens.
LOWER = Analyzer(filters=(lowercase,))


def field_column(docs: DataFrame, name: str) -> str:
    """The column of a field by its name or an alias; ValueError if there is none."""
    for c in (name, ALIASES.get(name, name)):
        if c in docs.columns:
            return c
    raise ValueError(f"no field {name!r} in {docs.columns}")


def text_length(text: Column, unit: str) -> Column:
    """In chars or bytes."""
    return {"chars": F.char_length, "bytes": F.octet_length}[unit](text)


def postings(docs: DataFrame, field: str = "text", analyzer: Analyzer = LOWER, id_col: str = "doc_id", binary_tf: bool = False, unit: str | None = None, parts: int | None = None) -> DataFrame:
    """(field, token, doc_id, tf): occurrences of each token in each document; tf is 1 throughout with binary_tf. With a unit also field_len, as in doc_stats.

    Documents are spread by their id first, so that texts in few files still are analyzed by all cores. As tokens of a document then are in
    one place, they are counted there: texts are shuffled, but no tokens. The number of tasks, where `parts` doesn't give it, goes with the
    stored size of the documents.
    """
    column = F.col(field_column(docs, field))
    spark = docs.sparkSession
    length = [text_length(column, unit).cast("long").alias("field_len")] if unit else []
    rows = docs.select(F.col(id_col).alias("doc_id"), column.alias("__text"), *length).repartition(parts or tasks(spark, stored_bytes(docs), TASK_BYTES), "doc_id")
    tokens = rows.select("doc_id", F.explode(analyzer(F.col("__text"))).alias("token"), *["field_len"] * len(length))
    counted = tokens.groupBy("doc_id", "token").agg(F.count("*").cast("int").alias("tf"), *[F.max("field_len").alias("field_len")] * len(length))
    return counted.select(F.lit(field).alias("field"), "token", "doc_id", (F.lit(1) if binary_tf else F.col("tf")).alias("tf"), *["field_len"] * len(length))


def doc_stats(docs: DataFrame, field: str = "text", id_col: str = "doc_id", unit: str = "chars", keep: Sequence[str] = ()) -> DataFrame:
    """(field, doc_id, field_len) and the columns to keep: length in chars or bytes; -1 where the field is null."""
    return docs.select(F.lit(field).alias("field"), F.col(id_col).alias("doc_id"), F.coalesce(text_length(F.col(field_column(docs, field)), unit), F.lit(-1)).cast("long").alias("field_len"), *keep)


def vocabulary(post: DataFrame) -> DataFrame:
    """(field, token, df, cf)."""
    return post.groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """One postings table of several; counts of the same token and document add up."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("field", "token", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def posting_lists(post: DataFrame) -> DataFrame:
    """(field, token, doc_ids, tfs): ascending ids and the counts beside them. A list is one value, so this is an export form; queries use the long form."""
    listed = post.groupBy("field", "token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return listed.select("field", "token", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"))


def posting_map(post: DataFrame) -> DataFrame:
    """(field, token, docs): doc_id -> tf as a map."""
    return posting_lists(post).select("field", "token", F.map_from_arrays("doc_ids", "tfs").alias("docs"))


def term_frequency(post: DataFrame, token: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tf) of every id, 0 where the token is absent."""
    own = post.filter(F.col("token") == token).select("doc_id", "tf")
    return ids.select(F.col(id_col).alias("doc_id")).join(own, "doc_id", "left").select("doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))


def document_fields(docs: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fields) and the columns to keep: the names of the fields that a document has, those that aren't null."""
    names = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in docs.columns if c not in (id_col, *keep)]
    return docs.select(F.col(id_col).alias("doc_id"), F.array_compact(F.array(*names)).alias("fields") if names else F.array().cast("array<string>").alias("fields"), *keep)


def unbuilt(docs: DataFrame, build_log: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """The documents that the build log doesn't have for the field."""
    done = build_log.filter(F.col("field") == field).select(F.col("doc_id").alias("__built"))
    return docs.join(done, F.col(id_col) == F.col("__built"), "left_anti")


def multi_field(docs: DataFrame, fields: Sequence[str], analyzer: Analyzer = LOWER, id_col: str = "doc_id") -> DataFrame:
    """Postings of several fields."""
    out = postings(docs, fields[0], analyzer, id_col)
    for f in fields[1:]:
        out = out.unionByName(postings(docs, f, analyzer, id_col))
    return out
