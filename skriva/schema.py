"""Schemas of the engine's tables, and the query levels."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

NEWS = T.StructType([T.StructField("category", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])
SUBLINK = T.StructType([T.StructField("_linktype", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("link", T.StringType())])
WIKI_XML = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("links", T.StructType([T.StructField("sublink", T.ArrayType(SUBLINK))])),
    ]
)
POSTINGS = "field string, token string, doc_id long, tf int"
DOC_STATS = "field string, doc_id long, field_len long"
VOCAB = "field string, token string, df long, cf long"
INDEX_POSTINGS = "field string, token string, doc_id long, tf int, field_len long"
BUILD_LOG = "field string, doc_id long, field_len long, load long, batch_id long"
REPLACED = "field string, doc_id long"
CORPUS = "field string, docs long, chars long"
DICTIONARY = "name string, word string"
TERM_RECORDS = "suffix string, id long, ref_count int"
#: Other names under which a document's fields are known.
ALIASES = {"Title": "title", "Content": "content", "Catgory": "category", "Category": "category", "Url": "url", "URL": "url", "Abstract": "abstract", "Text": "text"}


class QueryLevel(IntEnum):
    AT_LEAST = 0
    AT_OR = 1
    AT_AND = 2


class NotFound(LookupError):
    """No document matches, or a key isn't there."""


class KeyExists(ValueError):
    """A key that is to be inserted is already there."""
