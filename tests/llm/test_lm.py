import math

import numpy as np
import pytest

from skriva.llm import lm as L

from . import edge


def brute(spark, docs, order=L.ORDER, folds=L.FOLDS):
    """A model as dictionaries for each fold, of all rows that aren't in it."""
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(folds)).alias("fold")).collect()
    models = {f: L.Model(order) for f in {r.fold for r in rows}}
    for f, m in models.items():
        for r in rows:
            if r.fold != f:
                m.add(r.text or "")
    return sorted(((str(r.doc_id), len((r.text or "").encode()), round(models[r.fold].bits(r.text or ""), 2)) for r in rows), key=str)


def near(got, want):
    return len(got) == len(want) and all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-5, abs_tol=0.05) for a, b in zip(got, want))


@pytest.mark.parametrize("order, block, part, fan, folds", [(2, 1000, 500, 2, 2), (4, 2000, 1000, 3, 5), (4, 8 << 20, 16 << 20, 64, L.FOLDS), (5, 2000, 1000, 64, 3)])
def test_score_is_brute_force(spark, order, block, part, fan, folds):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substring(text, 1, 300) AS text").limit(60)
    docs = docs.union(spark.createDataFrame([(900, "abracadabra"), (900, "abracadabra"), (901, None), (902, ""), (None, "\u0000é")], "doc_id long, text string")).cache()
    got = sorted(((str(r.doc_id), r.n_bytes, r.bits) for r in L.score(docs, order=order, block_bytes=block, part_bytes=part, fan=fan, folds=folds).collect()), key=str)
    assert near(got, brute(spark, docs, order, folds))


def test_packing():
    for a in (np.array([], np.int64), np.array([5]), np.array([-3, 0, 2**39, 2**40])):
        assert (L.unpack(L.pack(a.astype(np.int64))) == a).all()


def test_grams():
    texts = [b"abcab", b"", b"a", bytes(range(256)) * 3]
    node, value, starts = L.number_grams(texts, 3)
    want = []
    for t in texts:
        d = bytes(3) + t
        want += [int.from_bytes(d[i : i + 4], "big") for i in range(len(t))]
    assert value[node].tolist() == want and starts.tolist() == [0, 5, 5, 6]


def test_adaptive(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a" * 200), (3, None), (4, ""), (None, "b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.score_adaptive(docs).collect()}
    assert rows[1].bits == 8.0 and rows[2].bits_per_byte < 0.5 and rows[3].bits == 0 and rows[4].bits_per_byte is None and rows[None].bits == 8.0
    m, total = L.Model(2), 0.0
    for at in m._positions("abab"):
        p = sum(2 ** -m.symbol_bits(at[0], s) for s in range(256))
        assert p <= 1 + 1e-9
        total += m.symbol_bits(*at)
        m.learn(*at)
    assert math.isclose(total, L.adaptive_bits("abab", 2))


def test_probabilities_add_up_to_one_at_most():
    m = L.Model(3)
    m.add("the cat sat on the mat and the rat")
    for context in (b"the", b"xyz", b" ca", bytes(3)):
        assert sum(2 ** -m.symbol_bits(context, s) for s in range(256)) <= 1 + 1e-9


def test_edge_cases(spark):
    docs = edge.table(spark)
    rows = L.score(docs).collect()
    assert len(rows) == len(edge.ROWS)
    by = {r.doc_id: r for r in rows}
    assert (by[3].n_bytes, by[3].bits, by[3].bits_per_byte) == (0, 0.0, None) and by[4].bits_per_byte is None and by[5].n_bytes == len(edge.LONG)
    assert L.score(edge.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "only text"), (1, "only text")], "doc_id long, text string")  # one document, twice
    assert [r.bits for r in L.score(one).collect()] == [72.0, 72.0]
    with pytest.raises(ValueError):
        L.score(docs, order=9)


def test_copies_predict_each_other(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 80))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:30])]
    got = {r.doc_id: r.bits_per_byte for r in L.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    cheap = {i for i, v in got.items() if v < 3}
    assert not cheap & set(range(30, 60)) and len(cheap & set(range(30))) > 22  # 15 of 16


def test_repeated_rows_travel_once(spark):
    docs = spark.range(5000).selectExpr("CAST(NULL AS long) AS doc_id", "'the very same text' AS text").union(spark.createDataFrame([(1, "the very other text")], "doc_id long, text string"))
    rows = L.score(docs).collect()
    assert len(rows) == 5001 and len({(r.doc_id, r.bits) for r in rows}) == 2
    assert L._distinct(docs, "doc_id", "text").count() == 2


def test_noise_costs_more_than_prose(spark):
    rng = np.random.default_rng(1)
    prose = [(i, "the river and the garden of the old house " * 3 + str(i)) for i in range(40)]
    noise = [(100 + i, "".join(map(chr, rng.integers(33, 126, 120)))) for i in range(5)]
    rows = {r.doc_id: r.bits_per_byte for r in L.score(spark.createDataFrame(prose + noise, "doc_id long, text string")).collect()}
    assert max(v for k, v in rows.items() if k < 100) < min(v for k, v in rows.items() if k >= 100)
