import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from skriva.functions import scalar as S
from skriva.functions.stem import stem
from skriva.functions.tagging import DictionaryTagger, noun_runs, tag_english


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def reference_id(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % 2**64
    h = (h * 6364136223846793005 + 1442695040888963407) % 2**64
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("text", ["", "a", "wiki#Title#http://x", "中文", "\U0001f600a", "x" * 300])
def test_text_id_is_exact(spark, text):
    assert one(spark, S.text_id(F.lit(text))) == reference_id(text)


def test_document_id_fixtures(spark):
    assert one(spark, S.document_id("wiki", F.lit("Title"), F.lit("http://x"))) == 3979278881196684995
    assert one(spark, S.text_id(F.lit("\U0001f600a"))) == 8096542083851105116


def test_sets_and_subsets(spark):
    a, b = F.lit([1, 3, 5]), F.lit([3, 4])
    assert one(spark, S.union_sorted(a, b)) == [1, 3, 4, 5]
    assert one(spark, S.intersect_sorted(a, b)) == [3]
    assert S.k_subsets(["a", "b", "c"], 2) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert S.k_subsets(["a"], 2) == [] and S.k_subsets([], 0) == []
    assert len(S.at_least_k_subsets(["a", "b", "c"], 2)) == 4


def test_string_helpers(spark):
    assert one(spark, S.common_prefix_length(F.lit("abcx"), F.lit("abd"))) == 2
    assert one(spark, S.common_prefix_length(F.lit("x"), F.lit(""))) == -1
    assert one(spark, S.token_of(F.lit("k!a!b"))) == "a!b" and one(spark, S.token_kind(F.lit("k!a"))) == "k"
    assert one(spark, S.tag_of(S.with_tag(F.lit(77).cast("long"), F.lit(-3)))) == -3
    assert one(spark, S.from_little_endian(S.little_endian(F.lit(-5).cast("long")))) == -5
    assert bytes(one(spark, S.little_endian(F.lit(258), 2))) == b"\x02\x01"
    assert one(spark, S.false_positive_rate(F.lit(1000), F.lit(0), 4)) == 0


def test_hashes_and_random_numbers(spark):
    assert one(spark, S.crc32(F.lit("some text"))) == zlib.crc32(b"some text")
    assert one(spark, S.sha256(F.lit("some text"))) == hashlib.sha256(b"some text").hexdigest()
    ids = [r.x for r in spark.range(2000).select(S.random_id(5).alias("x")).collect()]
    assert len(set(ids)) == 2000 and min(ids) >= 0 and max(ids) < 1 << 62 and max(ids) > 1 << 61
    assert 800 < sum(x & 1 for x in ids) < 1200  # the lowest bit is random too
    several = one(spark, S.random_ids(5))
    assert len(set(several)) == 5 and all(0 <= x < 1 << 62 for x in several)
    assert abs(one(spark, S.now_nanos()) / 1e9 - time.time()) < 60


@pytest.mark.parametrize("word, want", [("cat", "cat"), ("cats", "cat"), ("fish", "fish"), ("fishing", "fish"), ("fished", "fish"), ("airline", "airlin"), ("caresses", "caress"), ("generously", "generous"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("dying", "die"), ("", "")])
def test_stem(word, want):
    assert stem(word) == want


def test_english_tags():
    assert tag_english("A nouns is a word".split()) == ["DT", "NNS", "VB", "DT", "NN"]


def test_noun_runs():
    words = [("a", "n"), ("b", "nr"), ("c", "v"), ("d", "n")]
    assert noun_runs(words) == ["ab", "d"] and noun_runs(words, drop_last=True) == ["ab", "d"]
    assert noun_runs(words[:2], drop_last=True) == ["a"]
    tagger = DictionaryTagger({"天气": "n", "预报": "n", "很": "d"})
    assert noun_runs(tagger("天气预报很好")) == ["天气预报"]


def test_folders_of_results_can_be_removed(spark, tmp_path):
    from skriva.session import clean_shared, remove_shared, shared_dir, shared_path

    one, two = shared_path(spark, "some"), shared_path(spark, "other")
    for p in (one, two):
        spark.range(3).write.parquet(p)
    name = one.rpartition("/")[2]
    assert name not in clean_shared(spark) and spark.read.parquet(one).count() == 3
    remove_shared(spark, two)
    removed = clean_shared(spark, -1.0)
    assert name in removed and two.rpartition("/")[2] not in removed and shared_dir(spark)
