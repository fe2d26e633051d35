"""Term dictionary: exact, prefix and range lookup, insert, update, upsert, delete, reference counts, Bloom filters.

Any DataFrame with a string key column is a dictionary. Stored sorted by key, exact, prefix and range lookups become
pushed filters that prune files and row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import false_positive_rate
from ..schema import KeyExists, NotFound


def exact(df: DataFrame, key: str | int, col: str = "token") -> DataFrame:
    return df.filter(F.col(col) == F.lit(key))


def prefix(df: DataFrame, start: str, col: str = "token", inclusive: bool = False) -> DataFrame:
    """Keys below the prefix; the prefix itself only if inclusive."""
    below = F.col(col).startswith(start)
    return df.filter(below if inclusive else below & (F.col(col) != start))


def between(df: DataFrame, low: str, high: str, col: str = "token", upper: bool = True) -> DataFrame:
    """Keys from low to high; without the latter if not upper."""
    return df.filter((F.col(col) >= low) & (F.col(col) <= high if upper else F.col(col) < high))


def insert(df: DataFrame, new: DataFrame, col: str = "token") -> DataFrame:
    """df and the new rows; KeyExists if a key is there already (one small job checks that)."""
    if not new.join(df.select(col), col, "left_semi").isEmpty():
        raise KeyExists("a key is already in the dictionary")
    return df.unionByName(new)


def update(df: DataFrame, new: DataFrame, col: str = "token") -> DataFrame:
    """df with the values of `new`; NotFound if a key isn't there."""
    if not new.join(df.select(col), col, "left_anti").isEmpty():
        raise NotFound("a key isn't in the dictionary")
    return upsert(df, new, col)


def upsert(df: DataFrame, new: DataFrame, col: str = "token") -> DataFrame:
    """df with `new` in place of its rows of the same keys. `new` has each key once."""
    return df.join(new.select(col), col, "left_anti").select(*df.columns).unionByName(new)


def upsert_with(df: DataFrame, new: DataFrame, value: str, merge: Column, col: str = "token") -> DataFrame:
    """Of (key, value) tables: `merge` combines the columns `old` and `new` where a key is in both."""
    a, b = df.select(col, F.col(value).alias("old")), new.select(col, F.col(value).alias("new"))
    both = a.join(b, col, "full_outer")
    return both.select(col, F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old")).otherwise(merge).alias(value))


def delete(df: DataFrame, keys: DataFrame, col: str = "token") -> DataFrame:
    return df.join(keys.select(col), col, "left_anti")


def term_records(df: DataFrame, suffix: str = "suffix", id_col: str = "id") -> DataFrame:
    """(suffix, id, ref_count): each key once with its smallest id; ref_count tells how often it was inserted again."""
    return df.groupBy(F.col(suffix).alias("suffix")).agg(F.min(id_col).alias("id"), (F.count("*") - 1).cast("int").alias("ref_count"))


WORD = 32


def _places(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key, by double hashing."""
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)).bitwiseOR(F.lit(1))
    small = F.pmod(a, F.lit(bits)), F.pmod(b, F.lit(bits))
    return F.array(*[F.pmod(small[0] + small[1] * i, F.lit(bits)) for i in range(hashes)])


def bloom_build(df: DataFrame, col: str, bits: int = 1 << 20, hashes: int = 4) -> DataFrame:
    """A Bloom filter as the table (word, mask) of its words that aren't 0; partial aggregation keeps the shuffle at the filter's size."""
    places = df.select(F.explode(_places(F.col(col), bits, hashes)).alias("at"))
    return places.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(at % {WORD} AS INT))")).alias("mask"))


def bloom_merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of the same size."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    return both.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_test(df: DataFrame, col: str, bloom: DataFrame, bits: int = 1 << 20, hashes: int = 4) -> DataFrame:
    """The distinct keys of df with the column `found`: false is certain, true may be wrong at the rate of `bloom_rate`."""
    keys = df.select(col).distinct()
    probes = keys.select(col, F.explode(F.array_distinct(_places(F.col(col), bits, hashes))).alias("at")).withColumn("word", F.floor(F.col("at") / WORD))
    hit = F.coalesce(F.expr(f"shiftright(mask, CAST(at % {WORD} AS INT)) & 1L"), F.lit(0)) == 1
    return probes.join(bloom, "word", "left").groupBy(col).agg(F.min(hit).alias("found"))


def bloom_rate(bits: int, keys: Column, hashes: int = 4) -> Column:
    return false_positive_rate(F.lit(bits), keys, hashes)
