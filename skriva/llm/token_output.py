"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are encoded with a published byte-level BPE vocabulary (its path is a parameter), as whole texts, in an
Arrow UDF. Spark's own ORC writer stores them: the `tokens` and `n_tokens` columns as run-length encoded integer
streams, a row index entry every ROW_STRIDE rows, a Bloom filter on `doc_id` for each of those, and stripes of
about STRIPE_BYTES, which readers take in parallel. Rows are sorted by `doc_id` inside each file, so minima and
maxima prune as well as the Bloom filters do. Where the order of the rows is a schedule, `position` (see `file_position`) takes
the place of that sort: the rows keep it as a column, and each file is sorted by it. Commit and retry are those of Spark's writer.

Defined results: a null text has null tokens and n_tokens 0; an empty text has an empty list and 0; rows with a
null or repeated doc_id are kept as they are, rows of equal doc_id in no stated order; a text of any length is one row, encoded whole,
also where it is one run of white space; an empty table gives an empty file set that reads back with the
schema; further columns, also of names that differ by case only, are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, load, placed, shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRIPE_BYTES, ROW_STRIDE, FPP = 16 << 20, 1000, 0.01
#: A run of white space that the vocabulary's pattern can't go back through, as its stack is bounded.
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The ids of a whole text. Runs of white space of any length give the ids that the pattern defines: the run but for its last
    character is one piece, or the whole run where the text ends."""
    coder = encoding(path)
    if len(text) < 65536 or not (runs := list(_BLANK.finditer(text))):
        return coder.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    parts, at = [], 0
    for m in runs:
        end = m.end() - (m.end() < len(text))
        parts += [coder.encode_to_numpy(text[at : m.start()], disallowed_special=()), coder._encode_single_piece(text[m.start() : end])]
        at = end
    return np.concatenate([np.asarray(x, np.int32) for x in (*parts, coder.encode_to_numpy(text[at:], disallowed_special=()))])


def token_udf(path: str = VOCABULARY):
    @F.arrow_udf("array<int>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids = [None if not x.is_valid else encode(x.as_py(), path) for x in texts]  # never lists of Python integers, which take nine times the memory
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids], dtype=np.int32)
            null = pa.array([x is None for x in ids], pa.bool_())
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            del ids
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=null)

    return tokens


def file_position(docs: DataFrame) -> Column:
    """Where a row is in the order in which docs were written: ascending, not consecutive.

    Spark packs files into partitions by size, so the order of a reread isn't that of the writer. It is in the number
    that Spark's writer gives to each part, the number of the file within the part, and the row's place in the file.
    Rows that don't come from Parquet files have the order of their partitions.
    """
    meta = F.col("_metadata")
    try:
        docs.select(meta["file_name"], meta["row_index"]).schema  # a DataFrame that reads no Parquet has none
    except AnalysisException:
        return F.monotonically_increasing_id()
    part, file = (F.regexp_extract(meta["file_name"], r"^part-(\d+)-.*?(?:-c(\d+))?\.[^-]*$", k) for k in (1, 2))
    return F.shiftleft(part.cast("long"), 43) + F.shiftleft(F.when(file != "", file.cast("long")).otherwise(0), 33) + meta["row_index"]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, position: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens), sorted by doc_id within each partition; with a position, that as a fourth column, and sorted by it."""
    kept = [] if position is None else ["position"]
    docs = docs.withColumn("__position", position) if kept else docs
    rows = placed(docs).select(F.col(at(docs, id_col)).alias("doc_id"), F.col(at(docs, text_col)).alias("text"), *[F.col(at(docs, f"__{c}")).alias(c) for c in kept]).sortWithinPartitions("position" if kept else "doc_id")
    tokens = rows.select("doc_id", token_udf(vocabulary)("text").alias("tokens"), *kept)
    return tokens.select("doc_id", F.greatest(F.size("tokens"), F.lit(0)).alias("n_tokens"), "tokens", *kept)


def write_orc(tokens: DataFrame, path: str) -> None:
    (
        tokens.write.option("orc.compress", "ZSTD")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(FPP))
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def write_tokens(docs: DataFrame, path: str, **options: str | Column) -> DataFrame:
    """Encode docs, write them at path, and give the DataFrame that reads them."""
    out = tokenize(docs, **options)
    write_orc(out, path)
    return docs.sparkSession.read.schema(out.schema).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are skipped by their metadata."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(load(spark, sf_dir, "documents"), shared_path(spark, "tokens"))
