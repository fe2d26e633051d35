import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from skriva.llm import mixing as M

from . import edge


def test_query_is_its_sql(spark):
    con, path = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet'")
    want = con.execute(M.SQL).fetchall()
    got = M.query(spark, path).select("slot", "source", "block", "epoch", "doc_id", "first_token", "tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_van_der_corput():
    def point(i):
        x, unit = Fraction(0), Fraction(1, 2)
        while i:
            x, i, unit = x + (i & 1) * unit, i >> 1, unit / 2
        return x

    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().range(40).select("id", M.point(F.col("id"), "van_der_corput").alias("u")).collect()
    assert [r.u for r in rows] == [float(point(r.id)) for r in rows]
    with pytest.raises(ValueError):
        M.point(F.col("id"), "sobol")


@pytest.mark.parametrize("sequence", ["golden", "van_der_corput"])
def test_every_stretch_has_the_target_shares(spark, sequence):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    targets = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "source string, weight double")
    rows = M.schedule(docs, targets=targets, block_tokens=20, sequence=sequence).collect()
    slots = sorted({(r.slot, r.source) for r in rows})
    assert [s for s, _ in slots] == list(range(len(slots)))
    for start in range(0, len(slots) - 100, 50):
        share = sum(s == "a" for _, s in slots[start : start + 100]) / 100
        assert abs(share - 0.7) < 0.06
    seen = Counter(r.doc_id for r in rows)
    assert all(r.first_token == 0 for r in rows)  # blocks end between documents here
    assert len(seen) == 600 and max(r.epoch for r in rows if r.source == "b") == 0 and max(r.epoch for r in rows) > 0
    tokens = Counter()
    for r in rows:
        tokens[r.slot] += r.tokens
    assert set(tokens.values()) == {20}  # equal-token blocks
    ordered = [r.doc_id for r in M.mix(docs, targets=targets, block_tokens=20, sequence=sequence).collect()]
    assert Counter(ordered) == seen and ordered[:2] != sorted(ordered)[:2]


def test_running_total(spark):
    df = spark.createDataFrame([("g", str(p), i, i * p) for p in range(4) for i in range(5)], "g string, p string, i int, v long")
    rows = M.running_total(df, "g", "p", ["i"], "v", "at").orderBy("p", "i").collect()
    total = 0
    for r in rows:
        assert r["at"] == total
        total += r.v


def test_edge_cases(spark):
    docs = edge.table(spark)
    rows = M.schedule(docs).collect()
    assert {r.doc_id for r in rows} == {i for i, *_ in edge.ROWS} and {r.source for r in rows} == {"a", "b", "c", None}
    assert sum(r.tokens for r in rows if r.doc_id == 1 and r.source == "a" and r.epoch == 0) == 14  # both of the equal rows
    assert max(r.block for r in rows if r.doc_id == 5) > 40
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {i for i, *_ in edge.ROWS}
    assert mixed.filter("`__slot` <> 5 OR `__k` <> 'k' OR `__key` <> 'key'").count() == 0
    assert M.schedule(edge.empty(spark)).count() == 0 and M.mix(edge.empty(spark)).count() == 0
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.doc_id for r in M.schedule(none).collect()} == {i for i, *_ in edge.ROWS}
    odd = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None), (None, 2.0)], "source string, weight double")
    assert {r.source for r in M.schedule(docs, targets=odd).collect()} == {"a", None}
    assert M.schedule(docs, targets=odd.filter("weight < 0")).count() == 0


def test_documents_are_cut_at_the_ends_of_blocks(spark):
    """Every block but a source's last has exactly its tokens, and the pieces are the documents."""
    texts = [(i, " ".join(f"d{i}t{j}" for j in range(n)), "ab"[i % 2]) for i, n in enumerate([7, 0, 95, 13, 20, 41, 1, 33, 250, 9, 20, 20])] + [(100, "  日本語の 文 mixed文字 \n", "a"), (101, None, "b"), (102, "", "b"), (7, "other text of seven", "b"), (3, "x y", "b"), (3, "x y", "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = M.schedule(docs, block_tokens=20).collect()
    tokens, last = Counter(), {}
    for r in rows:
        tokens[r.slot, r.source, r.block] += r.tokens
        last[r.source] = max(r.block, last.get(r.source, 0))
    assert all(n == 20 or b == last[s] for (_, s, b), n in tokens.items()) and len({slot for slot, *_ in tokens}) == len(tokens)
    count = lambda t: len(M._TOKEN.findall(t or ""))
    assert count("  日本語の 文 mixed文字 \n") == 8
    got = {}
    for r in rows:
        if r.epoch == 0:
            got.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
    for i in {i for i, *_ in texts}:
        assert sum(n for _, n in got[i]) == sum(count(t) for j, t, _ in texts if j == i)
    mixed = [(r.doc_id, r.text, r.source) for r in M.mix(docs, block_tokens=20).collect()]
    order = [(r.doc_id, r.tokens) for r in rows]
    assert Counter((i, count(t)) for i, t, _ in mixed) == Counter(order)
    slot_tokens, at = [], 0
    by_slot = {slot: n for (slot, _, _), n in tokens.items()}
    for slot in sorted(by_slot):  # the written order is the schedule's
        n = sum(r.slot == slot for r in rows)
        slot_tokens.append(sum(count(t) for _, t, _ in mixed[at : at + n]))
        at += n
    assert at == len(mixed) and slot_tokens == [by_slot[s] for s in sorted(by_slot)]
    for i, t, _ in texts:
        parts = [x for j, x, _ in mixed if j == i]
        assert t in parts if not t or count(t) == 0 else "".join(parts).count(t) or len(parts) > 1
    long = [x for j, x, _ in mixed if j == 8]
    assert "".join(sorted(set(long), key=lambda x: int(re.search("t([0-9]+)", x)[1]))) == texts[8][1]
    assert M.pieces("a b c d e", 1, 2) == ["a ", "b c ", "d e"] and M.pieces(" a ", 1, 2) == [" a "]


def test_many_sources_meet_their_slots_by_cells(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(id % 50)) AS text", "concat('host', id) AS source")
    rows = M.schedule(docs, block_tokens=20)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows.select("doc_id").distinct().count() == 3000
