"""Tokenizers: Column expressions from a text to an array of tokens. All stay in the JVM and in the row, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = r"[^\s\x{85}\p{Z}]+"
PIECE = r"[^\s\x{85}\p{Z}][\p{L}\p{N}]*"
STRETCH = 512
BARE = r"[\p{L}\p{N}]+"


def english(text: Column, strip_separator: bool = False) -> Column:
    """Fields between white space, cut before each character that is neither letter nor number; that character stays in front.

    strip_separator takes it off, and drops tokens that then are empty: what stays are the runs of letters and numbers. A null text has no tokens.
    """
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BARE if strip_separator else PIECE), F.lit(0))


def english_positions(text: Column) -> Column:
    """Array of struct(field, token, pos): pos counts characters from the start of the field; the last piece of a field is left out."""

    kind = "array<struct<field:int,token:string,pos:int>>"

    def walk(parts: Column, number: Column, start: Column) -> Column:
        """Pieces one after the other; the array grows by copying, so parts are few."""
        return F.aggregate(
            parts,
            F.struct(start.alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p)).alias("at"),
                F.concat(acc["out"], F.array(F.struct(number.cast("int").alias("field"), p.alias("token"), acc["at"].alias("pos")))).alias("out"),
            ),
        )["out"]

    def pieces(field: Column, number: Column) -> Column:
        parts = F.regexp_extract_all(field, F.lit(PIECE), F.lit(0))
        kept = F.slice(parts, 1, F.size(parts) - 1)
        # a field of many pieces is walked in stretches, whose beginnings are the lengths of those before
        starts = F.sequence(F.lit(0), F.size(kept) - 1, F.lit(STRETCH))
        stretch = lambda i: F.slice(kept, i + 1, F.lit(STRETCH))
        lengths = F.transform(starts, lambda i: F.aggregate(stretch(i), F.lit(0), lambda n, p: n + F.length(p)))
        long = F.flatten(F.transform(starts, lambda i, k: walk(stretch(i), number, F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, n: a + n))))
        return F.when(F.size(parts) < 2, F.array().cast(kind)).when(F.size(kept) <= STRETCH, walk(kept, number, F.lit(0))).otherwise(long)

    fields = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIELD), F.lit(0))
    # fields of one piece give nothing, so most never reach the walk
    return F.flatten(F.filter(F.transform(fields, pieces), lambda x: F.size(x) > 0))


def chinese_segments(text: Column) -> Column:
    """The segments between CR LF; line and stop-word filters follow."""
    return F.split(F.coalesce(text, F.lit("")), "\r\n", -1)
