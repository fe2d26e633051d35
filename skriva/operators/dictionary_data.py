"""The packaged word lists: data/words.tsv has (list, place in the list, word), sorted; data/ORIGIN.md tells where they come from."""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = Path(__file__).parent.parent / "data" / "words.tsv"


@lru_cache(maxsize=None)
def words(name: str) -> tuple[str, ...]:
    """The words of one list ("en", "cn", "pause"), in its order, each once."""
    with _FILE.open(encoding="utf-8", newline="") as f:
        rows = [(int(place), word) for kind, place, word in csv.reader(f, delimiter="\t", quoting=csv.QUOTE_NONE) if kind == name]
    return tuple(dict.fromkeys(w for _, w in sorted(rows)))


def dictionary(spark: SparkSession, names: tuple[str, ...] = ("en", "cn", "pause")) -> DataFrame:
    """(name, word) of the packaged lists."""
    return spark.createDataFrame([(n, w) for n in names for w in words(n)], "name string, word string")


def read_dictionary(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, word) of text files of one word a line whose first line is "// count"; the file name up to "_" names the list."""
    rows = spark.read.text(pattern).select(F.regexp_extract(F.input_file_name(), r"([^/_]*)_[^/]*$", 1).alias("name"), F.trim(F.regexp_replace("value", "[\r﻿]", "")).alias("word"))
    return rows.filter("word <> '' AND NOT startswith(word, '//')").distinct()
