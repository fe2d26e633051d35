"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 128 bits; each distinct word of the folded text votes with weight 1 + ln(count) by the bits of its 128-bit hash.
Two documents are near-duplicates if their fingerprints differ in at most RADIUS bits; groups are the connected
components.

Search, exact for every number of segments m: a fingerprint is cut into m segments. With RADIUS = a m + b a pair within
RADIUS differs in at most a bits in one of the first b + 1 segments, or in at most a - 1 in one of the others, as more
bits in each would make more than RADIUS. Each distinct fingerprint is stored once under each of its
segments, and looks up the small Hamming ball around each of its segments; the tables' matches are verified by
the complete distance. A ball member that differs by the mask M is looked up only where that raises the
segment's value, so that a pair meets once a segment, and a pair is emitted only by the first of its segments that agrees.
m is chosen by the expected cost for the number of distinct fingerprints, so segments widen
as the corpus grows; the result is the same for all of them.

Only a part of a ball is shuffled: tables are spread by the upper bits of the segments, and a fingerprint goes once to each place
whose upper bits are in its ball. The masks of the lower bits are enumerated there, beside the table, in the same stage as the join.

Copies with equal fingerprints are one entry of the tables, however many they are.

Defined results: every row counts by its own text, also where rows share a doc_id or have none; texts that are null or
have no word have no fingerprint and are each a group of their own, with the row's doc_id as group_id; group_id is otherwise the smallest doc_id of the group, null if none has one.
Of a group the row of the smallest doc_id (those without one last) is kept, on a tie that of the smallest hash of id and text, and one of the rows that are equal in both. Texts of any length are read whole. Equal votes for and against a bit
give 0. An empty table gives an empty result; further columns, also of names that differ by case only, are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, exact, load, packed, session_conf

RADIUS, SEGMENTS = 15, (9, 8, 7, 6, 5, 4)
PLACE = 50_000
_WORD = re.compile(r"[^\W_]+")


def fingerprint(text: str | None) -> tuple[int, int] | None:
    """(high, low) signed 64-bit halves, or None without a word."""
    counts = Counter(_WORD.findall((text or "").lower()))
    if not counts:
        return None
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(w) for w in counts]), np.uint8).reshape(len(counts), 16)
    weights = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    votes = np.zeros(128, np.float32)
    for at in range(0, len(weights), 8192):
        part = weights[at : at + 8192]
        votes += part @ np.unpackbits(hashes[at : at + 8192], axis=1).astype(np.float32)
    bits = np.packbits(votes * 2 > weights.sum()).view(">i8")
    return int(bits[0]), int(bits[1])


def fingerprint_udf():
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])

    @F.arrow_udf("struct<hi:long,lo:long>")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t.as_py()) for t in texts]
            yield pa.array([f and {"hi": f[0], "lo": f[1]} for f in found], kind)

    return fingerprints


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def layout(m: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment of the 128 bits; -1 for a segment that needn't be looked at."""
    edges = [round(128 * k / m) for k in range(m + 1)]
    return [(a, b - a, radius // m - (k > radius % m)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def segment(prefix: str, part: tuple[int, int, int]) -> Column:
    """Bits are numbered from the lowest of `lo` up to the highest of `hi`."""
    at, width, _ = part
    hi, lo, mask = F.col(prefix + "hi"), F.col(prefix + "lo"), (1 << width) - 1
    if at >= 64:
        return F.shiftrightunsigned(hi, at - 64).bitwiseAND(mask)
    low = F.shiftrightunsigned(lo, at) if at else lo
    if at + width <= 64:
        return low.bitwiseAND(mask)
    return low.bitwiseOR(F.shiftleft(hi, 64 - at)).bitwiseAND(mask)


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def upper_bits(n: int, width: int) -> int:
    """How many bits spread a segment's table over places of about PLACE fingerprints, and over 64 at least."""
    return min(width - 1, 24, max(6, math.ceil(math.log2(max(2, n / PLACE)))))


def choose_segments(n: int, radius: int = RADIUS) -> int:
    """The number of segments with the least expected cost for n fingerprints. As measured a shuffled row costs four lookups, and a match half of one."""
    def cost(m: int) -> float:
        parts = [(w, r) for _, w, r in layout(m, radius) if r >= 0]
        return sum(4 * (1 + ball(upper_bits(n, w), r) / 2) + ball(w, r) / 2 * (1 + 0.5 * n / 2**w) for w, r in parts)

    return min(SEGMENTS, key=cost)


def near_pairs(prints: DataFrame, m: int, radius: int = RADIUS, n: int = 1 << 20) -> DataFrame:
    """(a, b) of all rows of prints (node, hi, lo), whose fingerprints are distinct, within the radius; each pair once. n is about their number.

    Both sides are spread by the segment and its upper bits (`place`); the join on all of its bits needs no further exchange where
    spark.sql.requireAllClusterKeysForCoPartition is off, as `pairs_of` sets it.
    """
    parts = [p for p in layout(m, radius) if p[2] >= 0]
    lows = [w - upper_bits(n, w) for _, w, _ in parts]
    longs = lambda values: F.array(*[F.lit(x).cast("long") for x in values])

    def by_segment(of: dict[int, Column]) -> Column:
        """The value for the row's segment s; a case for each different one."""
        out, groups = F.lit(None), {}
        for k, value in of.items():
            groups.setdefault(str(value._jc), (value, []))[1].append(k)
        for value, ks in groups.values():
            out = F.when(F.col("s").isin(ks), value).otherwise(out)
        return out

    stored = F.array(*[F.struct(F.lit(k).alias("s"), F.shiftrightunsigned(segment("", p), low).alias("up"), segment("", p).bitwiseAND((1 << low) - 1).cast("int").alias("own")) for k, (p, low) in enumerate(zip(parts, lows))])
    cut_up = prints.select("node", "hi", "lo", F.explode(stored).alias("x")).select("node", "hi", "lo", "x.*")
    place = lambda up: F.shiftleft(F.col("s"), 24).bitwiseOR(up.cast("int")).alias("place")
    # two keys of 4 bytes, which the join packs into one long
    table = cut_up.select(F.col("node").alias("tnode"), F.col("hi").alias("thi"), F.col("lo").alias("tlo"), place(F.col("up")), F.col("own").alias("down")).repartition("place")
    upper = by_segment({k: longs(masks(w - low, most)) for k, ((_, w, most), low) in enumerate(zip(parts, lows))})
    probes = cut_up.select("*", F.explode(upper).alias("x")).filter((F.col("x") == 0) | (F.col("up").bitwiseXOR(F.col("x")) > F.col("up")))
    most = by_segment({k: F.lit(most) for k, (*_, most) in enumerate(parts)})
    probes = probes.select("node", "hi", "lo", place(F.col("up").bitwiseXOR(F.col("x"))), "own", (most - F.bit_count("x")).cast("byte").alias("left"), (F.col("x") != 0).alias("moved")).repartition("place")
    probes = probes.withColumn("s", F.shiftright("place", 24))
    lower = by_segment({k: functools.reduce(lambda rest, left: F.when(F.col("left") == left, F.array(*map(F.lit, masks(low, left)))).otherwise(rest), range(most + 1), F.lit(None)) for k, ((*_, most), low) in enumerate(zip(parts, lows))})
    probes = probes.select("*", F.explode(lower).alias("x")).withColumn("down", F.col("own").bitwiseXOR(F.col("x")))
    probes = probes.filter(F.col("moved") | (F.col("x") == 0) | (F.col("down") > F.col("own")))
    met = probes.select("node", "hi", "lo", "s", "place", "down", (F.col("moved") | (F.col("x") != 0)).alias("moved")).join(table.hint("shuffle_hash"), ["place", "down"])
    earlier = F.lit(False)
    for k, p in enumerate(parts[:-1]):
        earlier = earlier | ((F.col("s") > k) & (F.bit_count(segment("", p).bitwiseXOR(segment("t", p))) <= p[2]))
    once = F.col("moved") | (F.col("node") < F.col("tnode"))
    return met.filter(once & (distance("", "t") <= radius) & ~earlier).select(F.least("node", "tnode").alias("a"), F.greatest("node", "tnode").alias("b"))


def pairs_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs of near_pairs, checkpointed, with the segments that suit the number of prints."""
    n = prints.count()
    with session_conf(prints.sparkSession, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return cut(near_pairs(prints, choose_segments(n, radius), radius, n))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node of its component.

    Each round a node takes the smallest label around it, and then that label's own label; it ends when
    nothing changes. Every round is cut by a checkpoint in the shared folder.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct().toDF("node", "other"))
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _labelled(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key of the row, hi, lo; fingerprints: hi, lo, label of the group, links to other rows from one of its own)."""
    rows = exact(docs, id_col, text_col).toDF("doc_id", "text")
    prints = cut(rows.select("doc_id", _key().alias("key"), fingerprint_udf()("text").alias("f")).select("doc_id", "key", "f.hi", "f.lo"))
    nodes = cut(prints.filter("hi IS NOT NULL").groupBy("hi", "lo").agg(F.count("*").alias("copies")))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # the same whenever it is read, as the checkpoint fixes the order
    pairs = pairs_of(nodes.select("node", "hi", "lo"), radius)
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    near = both.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("near"))
    label = components(pairs)
    found = nodes.join(near, "node", "left").join(label, "node", "left")
    return prints, cut(found.select("hi", "lo", F.coalesce("label", "node").alias("label"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")))


def _key() -> Column:
    """128 bits that stand for a row's doc_id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def _first(*more: str) -> Column:
    """Orders the rows of a group; a struct's null fields are least, so those come after by the flag."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, links, keep) of every row: links are the other rows whose text is near to its own; keep is true for one row of each group, and its equals."""
    prints, found = _labelled(docs, id_col, text_col, radius)
    placed = prints.join(found, ["hi", "lo"], "left").select("doc_id", "key", "label", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    best = placed.filter("label IS NOT NULL").groupBy("label").agg(F.min(_first()).alias("best"))
    out = placed.join(best, "label", "left")
    own = F.col("label").isNull()
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("group_id"), "links", (own | (F.col("best") == _first())).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all columns."""
    prints, found = _labelled(docs, id_col, text_col, radius)
    rows_of = prints.join(found, ["hi", "lo"]).groupBy("label", "doc_id", "key").agg(F.count("*").alias("n"))
    best = rows_of.groupBy("label").agg(F.min(_first("n")).alias("best")).select("best.key", (F.col("best.n") > 1).alias("repeated"))
    alone = prints.filter("hi IS NULL").select("key").distinct()
    rows = packed(docs, doc_id=id_col, text=text_col).select("row", _key().alias("key")).join(best.union(alone.withColumn("repeated", F.lit(False))), "key")
    once = rows.filter("repeated").groupBy("key").agg(F.first("row").alias("row"))  # of rows with words that are equal in both columns
    return rows.filter("NOT repeated").select("row").union(once.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
