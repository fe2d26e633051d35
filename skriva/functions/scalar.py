"""Scalar helpers as Column expressions; all but random ids are deterministic and stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal
from itertools import chain, combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "decimal(38,0)"


def code_points(text: Column) -> Column:
    """Array of the code points of a string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def text_id(text: Column) -> Column:
    """A 64-bit id of a string: h = 31 h + code point, then one step of a linear congruential generator, all modulo 2^64.

    Done in decimals, as ANSI mode raises on overflow of longs. The multiplier is split so that no product leaves 38 digits.
    """
    mod = F.lit(Decimal(1 << 64)).cast(_WORD)
    folded = F.aggregate(code_points(text), F.lit(0).cast(_WORD), lambda a, c: ((a * F.lit(31).cast("decimal(2,0)") + c.cast("decimal(10,0)")) % mod).cast(_WORD))
    high, low = divmod(6364136223846793005, 1 << 32)
    top = ((folded * F.lit(high).cast("decimal(12,0)")) % mod).cast("decimal(20,0)")
    shifted = ((top * F.lit(1 << 32).cast("decimal(12,0)")).cast(_WORD) % mod).cast("decimal(20,0)")
    rest = (folded * F.lit(low).cast("decimal(12,0)") % mod).cast("decimal(20,0)")
    whole = ((shifted + rest + F.lit(1442695040888963407).cast("decimal(20,0)")).cast(_WORD) % mod).cast("decimal(20,0)")
    return F.when(whole >= F.lit(Decimal(1 << 63)).cast(_WORD), whole - mod).otherwise(whole).cast("long")


def document_id(kind: str, *parts: Column) -> Column:
    """The id of a document of one kind with these identifying fields."""
    return text_id(F.concat_ws("#", F.lit(kind), *[F.coalesce(p, F.lit("")) for p in parts]))


def fast_id(kind: str, *parts: Column) -> Column:
    """The engine's own id: one xxhash64 call instead of a fold over code points."""
    return F.xxhash64(F.lit(kind), *parts)


sha256 = lambda x: F.sha2(x, 256)
crc32 = F.crc32


def union_sorted(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def intersect_sorted(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


contains = F.array_contains


def k_subsets(items: Sequence[str], k: int) -> list[tuple[str, ...]]:
    return list(combinations(items, k)) if 0 < k <= len(items) else []


def at_least_k_subsets(items: Sequence[str], k: int) -> list[tuple[str, ...]]:
    return list(chain.from_iterable(combinations(items, r) for r in range(max(1, k), len(items) + 1)))


def merge_strings(*parts: Column) -> Column:
    return F.concat_ws("#", *parts)


def split_strings(x: Column) -> Column:
    return F.split(x, "#")


def typed_token(token: Column, kind: Column) -> Column:
    return F.concat(kind, F.lit("!"), token)


def token_kind(x: Column) -> Column:
    return F.split_part(x, F.lit("!"), F.lit(1))


def token_of(x: Column) -> Column:
    """All that follows the first "!"; the whole string without one."""
    return F.when(F.instr(x, "!") > 0, F.substring(x, F.instr(x, "!") + 1, F.length(x))).otherwise(x)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Code points that two strings begin with in common, -1 if none."""
    n = F.least(F.length(a), F.length(b))
    hits = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))
    return F.when(hits == 0, F.lit(-1)).otherwise(hits)


def with_tag(value: Column, tag: Column) -> Column:
    """A 48-bit value with a 16-bit tag on top."""
    return value.bitwiseAND((1 << 48) - 1).bitwiseOR(F.shiftleft(tag.cast("long"), 48))


def tag_of(value: Column) -> Column:
    return F.shiftright(value, 48).cast("short")


def random_id(seed: int | None = None) -> Column:
    """A random number from 0 to 2^62 - 1, of 62 random bits."""
    seeds = (None, None) if seed is None else (seed, seed + 1)
    high, low = (F.floor((F.rand() if x is None else F.rand(x)) * float(1 << 31)).cast("long") for x in seeds)
    return F.shiftleft(high, 31).bitwiseOR(low)


def random_ids(n: int) -> Column:
    """An array of n random numbers."""
    return F.array(*[random_id() for _ in range(n)])


def now_nanos() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def false_positive_rate(bits: Column, keys: Column, hashes: int) -> Column:
    """Of a Bloom filter: (1 - e^(-kn/m))^k."""
    return F.pow(1 - F.exp(-hashes * keys.cast("double") / bits.cast("double")), F.lit(float(hashes)))


def little_endian(x: Column, width: int = 8) -> Column:
    """An integer's bytes, least first."""
    big = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 17 - 2 * (i + 1), 2) for i in range(width)]))


def from_little_endian(x: Column, width: int = 8) -> Column:
    """The unsigned integer (for width 8 the signed one) of such bytes."""
    digits = F.concat(*[F.substring(F.hex(x), 2 * (width - i) - 1, 2) for i in range(width)])
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return F.when(value >= F.lit(Decimal(1 << 63)).cast("decimal(20,0)"), value - F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("long")
