"""Language-model scoring: prediction by partial matching over bytes, with counts of the whole corpus.

A document's code length is the sum over its bytes of -log2 p. p comes from the longest context (ORDER bytes at most)
of the trie; where the byte is new there, the model escapes to the next shorter context with the estimate of method C
(distinct / (total + distinct)) and excludes the symbols of the longer one; after the empty context all
unseen bytes are equally likely. Counts are of all documents, in FOLDS folds by a hash of id and text: each document is
scored by the counts of the whole corpus without its own fold, so by 15 of 16 documents and never by itself. Copies under other ids are
other documents: they predict each other, but for the one in FOLDS that falls into the same fold, so what occurs twice costs fewer bits than what occurs once.

Method. With counts at rest the bits of a byte depend only on its gram (ORDER context bytes and itself), so:
1. documents are grouped into blocks of about BLOCK_BYTES by hash; per block, numpy numbers the trie's nodes level
   by level for all positions at once and gives the distinct grams with counts;
2. grams go by their last two context bytes into parts; as these fix the contexts of order 2 to ORDER, the bits of a
   part's grams with exclusion need no other part, but for the order-1 and order-0 counts, a table of at
   most FOLDS x 256 x 256 numbers that every task gets;
3. the blocks' lists of a part are merged FAN at a time, level by level, into one list of distinct grams with counts;
4. every FAN blocks' lists of a part meet that list in a task of their own, which answers them, and the blocks add
   the bits up by document.
What is gathered - distinct grams of every block - grows with the corpus, and no task holds more than a block, FAN
lists of a part, or a part's distinct grams, which a language bounds. Grams and bits travel as packed arrays.

`adaptive_bits` codes one text by a model that starts empty and learns as it goes; `score_adaptive` maps it over
documents. `Model` is the same as plain dictionaries, and what the tests hold the distributed form against.

Defined results: null and empty texts have 0 bytes, 0 bits and null bits a byte; a document starts in a context of
zero bytes; with a single document the other folds are empty and a byte costs 8 bits; rows that are equal in id and text are one document
that is counted and reported as often as they occur (so they travel once, however many they are); a null doc_id passes through, such rows are told apart by their texts; a text of any length is
one document of one block; an empty table gives an empty result; further
columns, also of names that differ by case only, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, exact, load, shared_path

ORDER, BLOCK_BYTES, PART_BYTES, MAX_PARTS, FAN, FOLDS = 4, 8 << 20, 16 << 20, 4096, 64, 16
_DENSE = 1 << 25


class Model:
    """The trie as dictionaries: context -> Counter of the next byte, for all orders."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def add(self, text: str | bytes) -> None:
        for at in self._positions(text):
            self.learn(*at)

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(self.order + 1):
            self.counts[context[self.order - j :]][symbol] += 1

    def _positions(self, text: str | bytes) -> Iterator[tuple[bytes, int]]:
        data = bytes(self.order) + (text.encode() if isinstance(text, str) else text)
        for i in range(self.order, len(data)):
            yield data[i - self.order : i], data[i]

    def symbol_bits(self, context: bytes, symbol: int) -> float:
        bits, gone = 0.0, set()
        for j in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - j :])
            if not seen:
                continue
            left = {c: n for c, n in seen.items() if c not in gone}
            total, distinct = sum(left.values()), len(left)
            if symbol in left:
                return bits + math.log2((total + distinct) / left[symbol])
            if distinct:
                bits += math.log2((total + distinct) / distinct)
            gone |= seen.keys()
        return bits + math.log2(256 - len(gone))

    def bits(self, text: str | bytes) -> float:
        return sum(self.symbol_bits(*at) for at in self._positions(text))


def adaptive_bits(text: str | None, order: int = ORDER) -> float:
    model, total = Model(order), 0.0
    for at in model._positions(text or ""):
        total += model.symbol_bits(*at)
        model.learn(*at)
    return total


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) with a model of each document alone; byte by byte in Python, so for small tables."""

    @F.arrow_udf("double")
    def bits(texts: pa.Array) -> pa.Array:
        return pa.array([adaptive_bits(t.as_py(), order) for t in texts], pa.float64())

    rows = exact(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.round(bits("text"), 3).alias("bits"))
    return rows.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)))


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers, by their differences."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def number_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram number at each position of the texts, ascending distinct grams by number, where each text starts).

    Positions are those of the texts laid end to end. A gram is its order + 1 bytes as an integer.
    """
    gap = bytes(order)
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    symbols = np.unique(data)
    rank = np.zeros(256, np.int32)
    rank[symbols] = np.arange(len(symbols))
    own = rank[data]
    node, value = own, symbols.astype(np.int64)
    for _ in range(order):
        width = len(symbols)
        size = len(value) * width
        key = node[:-1].astype(np.int32 if size < 1 << 31 else np.int64)
        key *= width
        key += own[len(own) - len(key) :]
        if size <= max(_DENSE, 4 * len(key)):
            there = np.zeros(size, bool)
            there[key] = True
            distinct = np.flatnonzero(there)
            number = np.cumsum(there, dtype=np.int32)
            node = number[key]
            node -= 1
            del there, number
        else:
            distinct, node = np.unique(key, return_inverse=True)
            node = node.astype(np.int32)
        value = (value[distinct // width] << 8) | symbols[distinct % width]
    # node[i] ends at data[i + order]; texts lie with a gap before each
    keep = np.ones(len(node), bool)
    for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        at = s + n + k * order
        keep[at : at + order] = False
    node = node[keep]
    return node, value, starts


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """By the two bytes before the last one."""
    return (((grams >> 8) & 0xFFFF) * 40503 >> 4) % parts


def block_grams(texts: list[bytes], times: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending grams, counts) of the texts, each occurring so many times."""
    node, value, _ = number_grams(texts, order)
    if (times == 1).all():
        counts = np.bincount(node, minlength=len(value))
    else:
        counts = np.zeros(len(value), np.int64)
        np.add.at(counts, node, np.repeat(times, [len(t) for t in texts]))
    return value[counts > 0], counts[counts > 0]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether it is there) in ascending keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_bits(grams: np.ndarray, train: np.ndarray, wanted: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """The bits of the wanted grams by the counts `train` of ascending grams; pairs[c, s] are the counts of byte s after byte c.

    `grams` has all grams whose last two context bytes are those of a wanted gram.
    """
    known, n = grams[train > 0], train[train > 0].astype(np.float64)
    levels = {}
    for j in range(order, 1, -1):
        keys, where = np.unique(known & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
        counts = np.bincount(where, n, len(keys))
        context, at = np.unique(keys >> 8, return_inverse=True)
        levels[j] = keys, counts, context, at, np.bincount(at, counts, len(context)), np.bincount(at, minlength=len(context)).astype(np.float64)
    pairs = pairs.astype(np.float64)
    single = pairs.sum(axis=0)
    bits, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    less_n, less_d = np.zeros(len(wanted)), np.zeros(len(wanted))

    def step(there: np.ndarray, total: np.ndarray, distinct: np.ndarray, count: np.ndarray, shadow: np.ndarray) -> None:
        nonlocal open_
        t, d = total - less_n, distinct - less_d
        hit = open_ & there & (count > 0)
        bits[hit] += np.log2((t[hit] + d[hit]) / count[hit])
        miss = open_ & there & (count == 0)
        paid = miss & (d > 0)
        bits[paid] += np.log2((t[paid] + d[paid]) / d[paid])
        less_n[miss], less_d[miss] = shadow[miss], distinct[miss]
        open_ = open_ & ~hit

    for j in range(order, 1, -1):
        keys, counts, context, at, total, distinct = levels[j]
        if not len(keys):
            continue
        suffix = keys & ((1 << 8 * j) - 1)
        if j > 2:
            below = levels[j - 1][1][_find(levels[j - 1][0], suffix)[0]]
        else:
            below = pairs[suffix >> 8, suffix & 255]
        shadow = np.bincount(at, below, len(context))
        gram = wanted & ((1 << 8 * (j + 1)) - 1)
        c, there = _find(context, gram >> 8)
        k, exact = _find(keys, gram)
        step(there, total[c], distinct[c], np.where(exact, counts[k], 0.0), shadow[c])
    c, s = (wanted >> 8) & 255, wanted & 255
    total, distinct = pairs.sum(axis=1), (pairs > 0).sum(axis=1).astype(np.float64)
    step(total[c] > 0, total[c], distinct[c], pairs[c, s], ((pairs > 0) @ single)[c])
    kinds = float((single > 0).sum())
    everything = np.full(len(wanted), single.sum())
    step(everything > 0, everything, np.full(len(wanted), kinds), single[s], everything)
    bits[open_] += np.log2(256 - kinds) if kinds < 256 else 0.0
    return bits


def _squeeze(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def _merged(table: pa.Table, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams, their counts in each fold) of rows (grams, folds), where a null in folds has no counts."""
    lists = [unpack(x) for x in table.column("grams").to_pylist()]
    grams = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
    train = np.zeros((folds, len(grams)), np.int64)
    for g, each in zip(lists, table.column("folds").to_pylist()):
        at = np.searchsorted(grams, g)
        for f, n in enumerate(each):
            if n is not None:
                train[f][at] += np.frombuffer(zstandard.ZstdDecompressor().decompress(n), "<i8")
    return grams, train


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _distinct(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, times): rows that are equal in both are one. Only such rows meet in a shuffle of texts; the others are found to be alone by 16 bytes each."""
    own = F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")
    rows = exact(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", "text", *own)
    again = cut(rows.groupBy("a", "b").agg(F.count("*").alias("times")).filter("times > 1"))
    if again.isEmpty():
        return rows.select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    alone = rows.join(again, ["a", "b"], "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    one = rows.join(again, ["a", "b"]).groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("times").alias("times"))
    return alone.union(one.select("doc_id", "text", "times"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, fan: int = FAN, folds: int = FOLDS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = _distinct(docs, id_col, text_col)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    half = max(1, -(-total // (folds * block_bytes)))
    parts = min(MAX_PARTS, max(4, -(-total // part_bytes)))
    chunks = -(-folds * half // fan)
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(folds))
    block = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(half)) * folds + fold
    rows = own.select(block.alias("block"), "doc_id", "text", "times")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        grams, counts = block_grams(_texts(table), table.column("times").to_numpy(), order)
        part = part_of(grams, parts)
        by = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by], np.arange(parts + 1))
        pairs = np.zeros(1 << 16, np.int64)
        np.add.at(pairs, grams & 0xFFFF, counts)
        some = [(p, by[a:b]) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        out = [(p, pack(grams[i]), _squeeze(counts[i])) for p, i in some]
        seen = np.flatnonzero(pairs)
        if len(seen):
            out.append((-1, seen.astype("<i8").tobytes(), _squeeze(pairs[seen])))
        columns = [pa.array([key[0].as_py()] * len(out), pa.int64()), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))]
        return pa.table(columns, ["block", "part", "grams", "counts"])

    path = shared_path(spark, "grams")
    rows.groupBy("block").applyInArrow(count, "block long, part long, grams binary, counts binary").write.parquet(path)
    lists = spark.read.parquet(path)

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, 1 << 16), np.int64)
        for b in batches:
            for k, g, c in zip(b.column("block").to_pylist(), b.column("grams").to_pylist(), b.column("counts").to_pylist()):
                sums[k % folds][np.frombuffer(g, "<i8")] += np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<i8")
        f, g = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(sums[f, g])], ["fold", "pair", "n"])

    pairs = np.zeros((folds, 256, 256), np.int64)  # at most FOLDS x 65536 rows, however large the corpus
    for r in lists.filter("part = -1").mapInArrow(add_pairs, "fold long, pair long, n long").groupBy("fold", "pair").agg(F.sum("n").alias("n")).toLocalIterator():
        pairs[r.fold, r.pair >> 8, r.pair & 255] = r.n
    pairs = pairs.sum(axis=0) - pairs  # of the corpus without the fold

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        grams, train = _merged(table, folds)
        each = [_squeeze(n) if n.any() else None for n in train]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()), "grams": pa.array([pack(grams)], pa.binary()), "folds": pa.array([each], pa.list_(pa.binary()))})

    chunk, fold_of = F.floor(F.col("block") / fan).alias("chunk"), F.pmod("block", F.lit(folds))
    by_fold = F.array(*[F.when(fold_of == f, F.col("counts")) for f in range(folds)])
    asked = lists.filter("part >= 0").select("part", chunk, "block", "grams", by_fold.alias("folds"))
    model, left = asked.drop("block"), chunks
    while True:
        path = shared_path(spark, "merged")
        model.groupBy("part", "chunk").applyInArrow(merge, "part long, chunk long, grams binary, folds array<binary>").write.parquet(path)
        model = spark.read.parquet(path)
        if left <= 1:
            break
        left = -(-left // fan)
        model = model.withColumn("chunk", F.floor(F.col("chunk") / fan))
    model = model.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = left.column("block").to_pylist()
        bits: list[bytes] = [b""] * len(blocks)
        if blocks:
            lists_ = [unpack(x) for x in left.column("grams").to_pylist()]
            grams, train = _merged(right, folds)
            whole = train.sum(axis=0)
            for f in {k % folds for k in blocks}:
                mine = [i for i, k in enumerate(blocks) if k % folds == f]
                wanted = np.unique(np.concatenate([lists_[i] for i in mine]))
                value = gram_bits(grams, whole - train[f], wanted, pairs[f], order)
                for i in mine:
                    bits[i] = value[np.searchsorted(wanted, lists_[i])].astype("<f4").tobytes()
        return pa.table({"block": left.column("block"), "grams": left.column("grams"), "bits": pa.array(bits, pa.binary())})

    answers = asked.select("part", "chunk", "block", "grams").groupBy("part", "chunk").cogroup(model.groupBy("part", "chunk")).applyInArrow(answer, "block long, grams binary, bits binary")

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left)
        node, value, starts = number_grams(texts, order)
        grams = np.concatenate([unpack(x) for x in right.column("grams").to_pylist()] or [np.zeros(0, np.int64)])
        cost = np.concatenate([np.frombuffer(x, "<f4") for x in right.column("bits").to_pylist()] or [np.zeros(0, "<f4")])
        by = np.argsort(grams)
        at, _ = _find(grams[by], value)
        own = cost[by][at].astype(np.float64) if len(grams) else np.zeros(len(value))
        sums = np.concatenate([[0.0], np.cumsum(own[node])])
        lengths = np.array([len(t) for t in texts], np.int64)
        bits = np.round(sums[starts + lengths] - sums[starts], 3)
        each = [None if not n else round(b / n, 6) for b, n in zip(bits.tolist(), lengths.tolist())]
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(lengths), "bits": pa.array(bits), "bits_per_byte": pa.array(each, pa.float64()), "times": left.column("times")})

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {id_type}, n_bytes long, bits double, bits_per_byte double, times long")
    return scored.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc_id", "n_bytes", "bits", "bits_per_byte")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
