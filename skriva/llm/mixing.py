"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i has the point u_i = frac(i * g), g the golden ratio's fraction in 31-bit integers (or the van der Corput point
in base 2), and belongs to the source whose stretch of the cumulative target weights holds u_i; so every stretch of the schedule has the
sources in nearly their target shares. The documents of each source are shuffled by a keyed hash, laid end to end, and cut into
blocks of BLOCK_TOKENS tokens, through the middle of documents where need be; the r-th slot of a source takes its block r modulo its number of blocks, whose
quotient is the epoch. Every block has exactly BLOCK_TOKENS tokens but for the last one of each source. The schedule ends with the slot by which every source has given all its blocks, so
every document appears; sources that have less than their target share repeat.

A document without tokens is in the block of the token before it. Tokens are
single ideographs and kana, and runs of other characters than these, space, tab and line ends. A piece of a document begins with its first token and ends
before the first token of the next piece, so that the pieces one after the other are the document. The default target is the share of blocks to the power
ALPHA; as a source has one block at least, a tiny one can't make the others repeat for thousands of slots. No source is ordered or counted by one task:
running totals are taken within hash ranges, whose totals are then added up. Only the list of sources itself, one row each, is summed up by one task.

Defined results: rows that share a doc_id follow each other, by a hash of their text; a null doc_id is replaced by a hash of the
text; equal rows are parted alike, each appearing in full; a null source is a source of its own; null and empty texts have 0 tokens and are kept; sources whose
target is missing, null or not above 0 have no slots; an empty table gives an empty result; texts of any length are cut as said; further columns, also of names that differ by case only, are ignored by `schedule` and
kept by `mix`, on every piece. Without any token in the table each source has one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, cut, exact, load, placed

BLOCK_TOKENS, ALPHA, SEED = 4096, 0.9, "mix-1"
GOLDEN, MODULUS, RANGE, CELLS = 1327217885, 1 << 31, 4096, 4096
#: Ideographs and kana.
SINGLE = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_SINGLE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SINGLE)
TOKEN = rf"[{_SINGLE}]|[^ \t\n\r{_SINGLE}]+"
_CHARS = "".join(f"{chr(a)}-{chr(b)}" for a, b in SINGLE)
_TOKEN = re.compile(rf"[{_CHARS}]|[^ \t\n\r{_CHARS}]+")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def pieces(text: str, first: int, size: int) -> list[str]:
    """The text cut before its token number `first` and before every size-th token after that."""
    out, begin, due = [], 0, first
    for n, m in enumerate(_TOKEN.finditer(text)):
        if n == due:
            out.append(text[begin : m.start()])
            begin, due = m.start(), due + size
    return [*out, text[begin:]]


def pieces_udf(size: int):
    @F.arrow_udf("array<string>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, firsts in batches:
            yield pa.array([None if t is None else pieces(t, n, size) for t, n in zip(texts.to_pylist(), firsts.to_pylist())], pa.list_(pa.string()))

    return split


def _source(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("-"))


def _key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.col(text_col))), F.lit("#"))))


def running_total(df: DataFrame, group: str, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` before each row of its group; `part` cuts the order into consecutive stretches."""
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(group, part).agg(F.sum(value).alias("__v")).select(group, part, F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(parts, [group, part]).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")


def point(slot: Column, sequence: str) -> Column:
    """The slot's point in [0, 1), exactly, by integers."""
    if sequence == "golden":
        return F.pmod(F.pmod(slot, F.lit(MODULUS)) * GOLDEN, F.lit(MODULUS)) / F.lit(float(MODULUS))
    if sequence == "van_der_corput":
        bits = F.reverse(F.lpad(F.bin(F.pmod(slot, F.lit(MODULUS))), 31, "0"))
        return F.conv(bits, 2, 10).cast("double") / F.lit(float(MODULUS))
    raise ValueError(f"no such sequence: {sequence}")


def shares(blocks: DataFrame, targets: DataFrame | None, alpha: float) -> DataFrame:
    """(k, blocks, lo, hi) of each source: its number of blocks and its stretch of the cumulative weights."""
    if targets is None:
        raw = blocks.withColumn("w", F.pow(F.col("blocks").cast("double"), F.lit(alpha)))
    else:
        t = targets.select(_source("source").alias("k"), F.col("weight").cast("double").alias("w")).filter("w > 0").groupBy("k").agg(F.sum("w").alias("w"))
        raw = blocks.join(t, "k")
    whole = Window.partitionBy(F.lit(0))
    to = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    w = raw.withColumn("w", F.round(F.col("w") / F.sum("w").over(whole), 12))
    return w.withColumn("hi", F.round(F.sum("w").over(to), 12)).withColumn("last", F.max("k").over(whole)).select(
        "k", "blocks", "w", F.round(F.col("hi") - F.col("w"), 12).alias("lo"), F.when(F.col("k") == F.col("last"), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))


def slots(spark: SparkSession, share: DataFrame, sequence: str) -> DataFrame:
    """(slot, k, block, epoch) of the schedule."""
    bound = share.agg(F.max(F.ceil(F.col("blocks") / F.col("w"))).alias("n"), F.count("*").alias("s")).first()
    if not bound.s:
        return spark.createDataFrame([], "slot long, k string, block long, epoch long")
    n = int(bound.n) + 16 * bound.s + 64  # the points' discrepancy is far below this
    raw = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id"), sequence).alias("u"), (F.col("id") / RANGE).cast("long").alias("part"))
    # a stretch of weights is met by way of the cells that it touches, so slots and sources are joined by an equal key
    grid = max(CELLS, int(bound.s))
    cell = lambda x: F.floor(F.least(x, F.lit(1.0)) * grid)
    touched = share.select("*", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    own = raw.withColumn("cell", cell(F.col("u"))).join(touched, "cell").filter("u >= lo AND u < hi").select("slot", "part", "k", "blocks", F.lit(1).cast("long").alias("one"))
    ranked = running_total(own, "k", "part", ["slot"], "one", "r")
    end = ranked.filter(F.col("r") == F.col("blocks") - 1).agg(F.max("slot")).first()[0]
    return ranked.filter(F.col("slot") <= end).select("slot", "k", F.pmod(F.col("r"), F.col("blocks")).alias("block"), F.floor(F.col("r") / F.col("blocks")).alias("epoch"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *keep: Column) -> DataFrame:
    """(k, key, tie, tokens) of each row, and what is to be kept. docs has been through placed()."""
    return docs.select(_source(source_col).alias("k"), _key(id_col, text_col, seed).alias("key"), F.xxhash64(text_col).alias("tie"), token_count(F.col(text_col)).alias("tokens"), *keep)


def _placed(rows: DataFrame, counts: DataFrame, targets: DataFrame | None, block_tokens: int, alpha: float, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their first token's place `at` in their source and their first and last block, slots). counts: the same rows, to be read again and again."""
    part = F.substring("key", 1, 5)
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("k", part.alias("part")).agg(F.sum("tokens").alias("v")).select("k", "part", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("k", "part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("part", part).withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums, ["k", "part"])
    laid = laid.withColumn("at", F.col("before") + F.col("within")).drop("part", "within", "before")
    first = F.when(F.col("tokens") == 0, F.greatest(F.col("at") - 1, F.lit(0))).otherwise(F.col("at"))
    last = F.col("at") + F.col("tokens") - 1
    laid = laid.withColumn("first", F.floor(first / block_tokens)).withColumn("last", F.greatest(F.col("first"), F.floor(last / block_tokens)))
    totals = counts.groupBy("k").agg(F.greatest(F.ceil(F.sum("tokens") / block_tokens), F.lit(1)).alias("blocks"))
    return laid, slots(rows.sparkSession, shares(totals, targets, alpha), sequence)


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: DataFrame | None = None, block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, sequence: str = "golden", seed: str = SEED) -> DataFrame:
    """(slot, source, block, epoch, doc_id, first_token, tokens), a row for each time a piece of a document appears.

    targets: (source, weight), or None for the shares of blocks to the power alpha. first_token and tokens tell which tokens of
    the document the piece has.
    """
    whole = exact(docs, id_col, text_col, source_col)
    rows = cut(_rows(whole, id_col, text_col, source_col, seed, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")))  # texts are read once for this
    laid, plan = _placed(rows, rows, targets, block_tokens, alpha, sequence)
    each = laid.withColumn("block", F.explode(F.sequence("first", "last")))
    begin, end = F.greatest(F.col("at"), F.col("block") * block_tokens), F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * block_tokens)
    each = each.select("k", "block", "doc_id", "source", F.greatest(begin - F.col("at"), F.lit(0)).alias("first_token"), F.greatest(end - begin, F.lit(0)).alias("tokens"))
    return each.withColumn("first_token", F.when(F.col("tokens") == 0, 0).otherwise(F.col("first_token"))).join(plan, ["k", "block"]).select("slot", "source", "block", "epoch", "doc_id", "first_token", "tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: DataFrame | None = None, block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, sequence: str = "golden", seed: str = SEED) -> DataFrame:
    """The pieces of docs in the order of the schedule, with all columns; repeated where a source repeats."""
    names = [at(docs, c) for c in (id_col, text_col, source_col)]
    rows = _rows(placed(docs), *names, seed, *[F.col(f"__{k}") for k in range(len(docs.columns))])
    laid, plan = _placed(rows, cut(rows.select("k", "key", "tie", "tokens")), targets, block_tokens, alpha, sequence)
    text = F.col(names[1])
    # only texts that lie in several blocks go through Python
    split = pieces_udf(block_tokens)(F.when(F.col("last") > F.col("first"), text), (F.col("first") + 1) * block_tokens - F.col("at"))
    each = laid.withColumn("pieces", split).select("*", F.posexplode(F.when(F.col("last") > F.col("first"), F.col("pieces")).otherwise(F.array(text))).alias("n", "piece"))
    each = each.drop("pieces", names[1]).withColumn("block", F.col("first") + F.col("n")).withColumnRenamed("piece", names[1])
    ordered = each.join(plan, ["k", "block"]).repartitionByRange("slot", "key", "tie").sortWithinPartitions("slot", "key", "tie", "n")
    return ordered.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(load(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('{SEED}|' || doc_id::VARCHAR) AS key, len(regexp_extract_all(text, '{TOKEN}'))::BIGINT AS tokens FROM documents),
a AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d),
q AS (SELECT *, (CASE WHEN tokens = 0 THEN greatest(pos - 1, 0) ELSE pos END) // {BLOCK_TOKENS} AS b0 FROM a),
p0 AS (SELECT *, unnest(generate_series(b0, greatest(b0, (pos + tokens - 1) // {BLOCK_TOKENS}))) AS block FROM q),
p AS (SELECT doc_id, source, block, CASE WHEN tokens = 0 THEN 0 ELSE greatest(block * {BLOCK_TOKENS} - pos, 0) END::BIGINT AS first_token,
  greatest(least(pos + tokens, (block + 1) * {BLOCK_TOKENS}) - greatest(pos, block * {BLOCK_TOKENS}), 0)::BIGINT AS tokens FROM p0),
b AS (SELECT source, greatest(ceil(sum(tokens) / {BLOCK_TOKENS}), 1)::BIGINT AS blocks FROM d GROUP BY source),
t AS (SELECT source, blocks, pow(blocks::DOUBLE, {ALPHA}::DOUBLE) AS w FROM b),
s0 AS (SELECT source, blocks, round(w / sum(w) OVER (), 12) AS w FROM t),
s1 AS (SELECT *, round(sum(w) OVER (ORDER BY source), 12) AS hi, max(source) OVER () AS last FROM s0),
s AS (SELECT source, blocks, w, round(hi - w, 12) AS lo, CASE WHEN source = last THEN 2.0::DOUBLE ELSE hi END AS hi FROM s1),
n AS (SELECT max(ceil(blocks / w))::BIGINT + 16 * count(*) + 64 AS n FROM s),
u AS (SELECT i AS slot, ((i % {MODULUS}) * {GOLDEN} % {MODULUS})::DOUBLE / {MODULUS}.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT n FROM n))) AS i)),
r AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r FROM u JOIN s ON u.u >= s.lo AND u.u < s.hi),
e AS (SELECT max(slot) AS e FROM r WHERE r = blocks - 1)
SELECT slot, source, block, epoch, doc_id, first_token, tokens FROM p JOIN (SELECT slot, source, (r % blocks)::BIGINT AS block, (r // blocks)::BIGINT AS epoch FROM r, e WHERE slot <= e) USING (source, block)
"""
