"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are normalised (lower case; every run of other characters than letters and numbers is
one space; a space at either end). The patterns are all windows of WINDOW consecutive words of the items; an
item with fewer words is one pattern, and one of fewer than LEAST words, which would occur by chance, is one only as a document's whole text.
A document is reported with an item once any of its patterns occurs.

The search follows Wu and Manber: with m the length of the shortest pattern in bytes, a table indexed by the
hash of the BLOCK bytes that end at the cursor tells how far the cursor may move without passing an
occurrence. Where it says 0, the bucket of that hash lists the patterns whose m-th byte may be here, and
direct comparison confirms them. numpy moves thousands of cursors at once, each through its own stretch of a
batch of whole texts; as cursors look backward only, no stretch needs an overlap. Windows and shorter items have a table each, so
that a short item doesn't make the steps of all others short.

Patterns are places in one string of all items, so they take some 40 bytes each beside it. One pass over the documents searches for
at most MAX_BYTES of item text, whose patterns take about ten times as much in each Python worker; more of it means more
passes, each with the next set.

Defined results: null texts, texts and items without letters and numbers, and null items match nothing; rows of one
doc_id count as one document, with the distinct patterns of all their texts; items that repeat
under one id count once, other texts under the same id count as further windows of it, equal items under several ids are all reported; null ids take part like any other
value; texts of any length are searched whole; an empty table on either side gives no rows; other columns, also of names that differ by case only, are ignored
(`drop_contaminated` keeps them, and drops a row by its own text).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, exact, load, placed, restored

WINDOW, LEAST = 13, 5
MAX_BYTES = 32 << 20
BLOCK, LANE, CHUNK = 8, 512, 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def windows(text: bytes, size: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the distinct windows of a normalised text, with the spaces around them; the whole text if it has fewer words."""
    cuts = [k for k, c in enumerate(text) if c == 32]
    if len(cuts) - 1 <= size:
        return [(0, len(text))] if len(cuts) > 1 else []
    found = {text[a : b + 1]: (a, b + 1) for a, b in zip(reversed(cuts[:-size]), reversed(cuts[size:]))}
    return sorted(found.values())


class WuManber:
    """Search for many byte strings, the places [start, end) of one string; find() gives (positions of first bytes, numbers of the patterns)."""

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray):
        if not len(starts) or (ends <= starts).any():
            raise ValueError("patterns must be non-empty")
        self.text, self.starts, self.ends = text, starts, ends
        self.m = m = int((ends - starts).min())
        self.block = block = min(BLOCK, m)
        self.mask = np.uint64((1 << (8 * block)) - 1)
        self.bits = min(27, max(16, int(len(starts) * (m - block + 1)).bit_length() + 2))
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        words = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
        for end in range(block, m + 1):
            h = self._hash(words[starts + (end - block)])
            self.shift[h] = np.minimum(self.shift[h], m - end)  # the same for equal hashes, so their order doesn't matter
        self.order = np.argsort(h, kind="stable").astype(np.int32)  # buckets: patterns by the hash of their m-th byte
        self.keys = h[self.order].astype(np.int32)

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (((block & self.mask) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, data: bytes) -> list[tuple[int, int]]:
        m, block, n = self.m, self.block, len(data)
        if n < m:
            return []
        words = np.ndarray((n + 1,), "<u8", data + bytes(8), strides=(1,))
        cursor = np.arange(m, n + 1, LANE)  # one past the last byte of the m bytes looked at
        stop = np.minimum(cursor + LANE, n + 1)
        found = []
        while cursor.size:
            h = self._hash(words[cursor - block])
            step = self.shift[h]
            hit = step == 0
            if hit.any():
                lo, hi = (np.searchsorted(self.keys, h[hit], side=x) for x in ("left", "right"))
                for p, a, b in zip((cursor[hit] - m).tolist(), lo.tolist(), hi.tolist()):
                    for k in self.order[a:b].tolist():
                        s, e = self.starts[k], self.ends[k]
                        if data[p : p + e - s] == self.text[s:e]:
                            found.append((p, k))
                step = np.where(hit, 1, step)
            cursor = cursor + step
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        return found


class Finder:
    """Which items of a set occur in normalised texts."""

    def __init__(self, items: list[tuple[int, str]]):
        """items: (number, normalised text); a number may have several texts."""
        self.total: dict[int, int] = {}
        seen: dict[int, set[bytes]] = {}  # of numbers with several texts
        numbers = Counter(n for n, _ in items)
        text, at, long, short = [], 0, [], []
        for number, item in items:
            raw = item.encode()
            own = windows(raw)
            if numbers[number] > 1:
                known = seen.setdefault(number, set())
                own = [(a, b) for a, b in own if raw[a:b] not in known]
                known.update(raw[a:b] for a, b in own)
            self.total[number] = self.total.get(number, 0) + len(own)
            words = raw.count(b" ") - 1
            if own and words < LEAST:  # the NULs are those around a whole text
                raw, own = b"\0" + raw + b"\0", [(0, len(raw) + 2)]
            (long if words >= WINDOW else short).extend((at + a, at + b, number) for a, b in own)
            text.append(raw)
            at += len(raw)
        whole = b"".join(text)
        self.machines = []
        for places in (long, short):
            if places:
                a, b, owner = np.array(places, np.int64).T
                self.machines.append((WuManber(whole, a, b), owner))

    def search(self, texts: list[bytes | None]) -> list[list[tuple[int, bytes]]]:
        """For each text, (item, pattern) of the distinct patterns that occur, by item."""
        out: list[list[tuple[int, bytes]]] = [[] for _ in texts]
        first, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t or b"")
            if size >= CHUNK or k == len(texts) - 1:
                self._search(texts, first, k + 1, out)
                first, size = k + 1, 0
        return out

    def _search(self, texts: list[bytes | None], lo: int, hi: int, out: list) -> None:
        some = [t or b"" for t in texts[lo:hi]]
        data = b"\0" + b"\0".join(some) + b"\0"
        starts = np.cumsum([1] + [len(t) + 1 for t in some])
        for machine, owner in self.machines:
            found = machine.find(data)
            rows = np.searchsorted(starts, [p + (data[p] == 0) for p, _ in found], side="right") - 1
            for row, k in sorted({(r, k) for r, (_, k) in zip(rows.tolist(), found)}):
                out[lo + row].append((int(owner[k]), machine.text[machine.starts[k] : machine.ends[k]]))


def finder_udf(finder: Finder):
    """An Arrow UDF: normalised text -> array of struct(item, pattern), a pattern by a hash of 64 bits."""
    kind = pa.list_(pa.struct([("item", pa.int32()), ("pattern", pa.int64())]))

    @F.arrow_udf("array<struct<item:int,pattern:long>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for texts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            yield pa.array([[{"item": i, "pattern": xxhash.xxh3_64_intdigest(p) - (1 << 63)} for i, p in x] for x in finder.search(raw)], kind)

    return search


def item_sets(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The distinct (id, normalised item) rows in sets of at most max_bytes (one item at least)."""
    items = exact(benchmark, id_col, text_col).toDF("id", "t").select("id", normalised(F.col("t")).alias("t")).filter("length(t) > 2").distinct()
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    parts = -(-size // max_bytes)
    for part in range(parts):
        mine, now, used = items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id", "t"), [], 0
        for r in mine.toLocalIterator():
            if now and used + len(r.t.encode()) > max_bytes:
                yield now
                now, used = [], 0
            now.append((r.id, r.t))
            used += len(r.t.encode())
        if now:
            yield now


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows) of every document and item that share a pattern."""
    spark = docs.sparkSession
    texts = exact(docs, id_col, text_col).toDF("doc_id", "t").select("doc_id", normalised(F.col("t")).alias("t"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    hits = spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, pattern long")
    totals = spark.createDataFrame([], f"item_id {item_type}, n int")
    for items in item_sets(benchmark, item_col, item_text_col, max_bytes):
        numbers = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items))}
        finder = Finder([(numbers[i], t) for i, t in items])
        names = spark.createDataFrame([(k, i, finder.total[k]) for i, k in numbers.items()], f"item int, item_id {item_type}, n int")
        rows = texts.select("doc_id", F.explode(finder_udf(finder)("t")).alias("h")).select("doc_id", "h.*")
        hits = hits.union(rows.join(F.broadcast(names), "item").select("doc_id", "item_id", "pattern"))  # names is of one set, so bounded
        totals = totals.union(names.select("item_id", "n"))
    found = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("pattern").cast("int").alias("matched_windows"))
    sizes = totals.groupBy(F.col("item_id").alias("of")).agg(F.sum("n").cast("int").alias("item_windows"))
    return found.join(sizes, F.col("item_id").eqNullSafe(F.col("of"))).select("doc_id", "item_id", "matched_windows", "item_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs in which no pattern occurs, with all columns."""
    rows = placed(docs)
    for items in item_sets(benchmark, item_col, item_text_col, max_bytes):
        rows = rows.filter(F.coalesce(F.size(finder_udf(Finder([(k, t) for k, (_, t) in enumerate(items)]))(normalised(F.col(at(docs, text_col))))), F.lit(0)) <= 0)
    return restored(rows, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]')),
b AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w FROM benchmark WHERE regexp_matches(text, '[\p{L}\p{N}]')),
bw AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w[i:i+12], ' ') g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) i FROM b)),
total AS (SELECT item_id, count(DISTINCT g) c FROM bw GROUP BY item_id),
sizes AS (SELECT DISTINCT least(n, 13) n FROM bw),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+n-1], ' ') g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM d, sizes WHERE len(w) = n OR (len(w) > n AND n >= 5)))
SELECT doc_id, item_id, count(*)::INT AS matched_windows, max(c)::INT AS item_windows
FROM dw JOIN (SELECT DISTINCT item_id, g FROM bw) USING (g) JOIN total USING (item_id) GROUP BY doc_id, item_id
"""
