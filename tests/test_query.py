import math
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skriva.engine import SearchEngine
from skriva.operators import query as Q
from skriva.schema import NotFound, QueryLevel
from skriva.streaming.build import read_index


def table(spark, docs):
    return spark.createDataFrame([("text", t, i, d.split().count(t)) for i, d in enumerate(docs) for t in sorted(set(d.split()))] or [], "field string, token string, doc_id long, tf int")


def brute(docs, tokens, sizes, every):
    test, sep = (all, "&") if every else (any, "|")
    return sorted((sep.join(g), i) for r in sizes for g in combinations(sorted(set(tokens)), r) for i, d in enumerate(docs) if test(t in d.split() for t in g))


def rows(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdx"), max_size=5).map(" ".join), min_size=1, max_size=8))
def test_boolean_family(spark, docs):
    post, tokens = table(spark, docs), ["b", "a", "d", "c", "a"]
    assert rows(Q.query_or(post, tokens)) == brute(docs, tokens, [4], False)
    assert rows(Q.query_and(post, tokens)) == brute(docs, tokens, [4], True)
    for k, size in ((0.25, 1), (0.5, 2), (1.0, 4)):
        assert rows(Q.query_and_k(post, tokens, k)) == brute(docs, tokens, [size], True)
        assert rows(Q.query_or_k(post, tokens, k)) == brute(docs, tokens, [size], False)
        least = Q.query_and_k(post, tokens, k, at_least=True)
        assert rows(least) == brute(docs, tokens, range(size, 5), True)
        assert rows(Q.query_or_k(post, tokens, k, at_least=True)) == brute(docs, tokens, range(size, 5), False)
        assert {d for _, d in rows(least)} == {d for d, _ in rows(Q.matching(post, tokens, size))}


def test_empty_and_unknown(spark):
    post = table(spark, ["a b", "b"])
    assert rows(Q.query_or(post, [])) == [] and rows(Q.query_and(post, ["zz"])) == [] and rows(Q.query_and(post, ["a", "zz"])) == []
    assert Q.absolute_k(5, 0.5) == 2 and Q.absolute_k(1, 0.1) == 1 and Q.absolute_k(3, 9) == 3
    with pytest.raises(ValueError):
        Q.k_groups([str(i) for i in range(20)], 0.5, False)


def test_bm25(spark):
    docs = ["a a b", "b c", "a", "c c c c"]
    post = table(spark, docs)
    stats = spark.createDataFrame([("text", i, len(d)) for i, d in enumerate(docs)], "field string, doc_id long, field_len long")
    n, mean = 3, (5 + 3 + 1) / 3
    want = {}
    for i, d in enumerate(docs[:3]):
        s = 0.0
        for t, df in (("a", 2), ("b", 2)):
            tf = d.split().count(t)
            s += math.log((n - df + 0.5) / (df + 0.5)) * tf * 2 / (tf + 0.5 + 0.5 * len(d) / mean)
        want[i] = round(s, 6)
    ranked = Q.bm25(post, stats, ["a", "b"])
    assert {r.doc_id: r.score for r in ranked.collect()} == want
    middle = sorted(want.values(), reverse=True)[1]
    assert [tuple(r) for r in Q.group_scores(ranked).collect()] == [("a|b", 3, middle)]
    best = max(want, key=lambda i: (want[i], -i))
    assert [(r.doc_id, r["rank"]) for r in Q.top_k(ranked, 1).collect()] == [(best, 1)]
    plus = Q.bm25(post, stats, ["a", "a"], n_scope="corpus", idf="plus1", k2=1.0)
    assert all(r.score > 0 for r in plus.collect()) and plus.count() == 2
    with pytest.raises(ValueError):
        Q.bm25(post, stats, ["a"], n_scope="x")


def test_even_groups_take_the_lower_middle(spark):
    ranked = spark.createDataFrame([("g", i, float(i)) for i in range(4)], "token_group string, doc_id long, score double")
    assert Q.group_scores(ranked).first().group_score == 1.0  # 3 2 1 0, place 2


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red fish"), (2, "red Cat"), (3, "blue fish"), (4, None)], "doc_id long, text string")
    e = SearchEngine(spark, str(tmp_path), strict=True, k1=1.0, b=0.5)
    assert e.load(docs.filter("doc_id < 3"), "first") == 2
    told = []
    assert e.build("text", lambda batch, n: told.append((batch, n))) == 2 and e.build("text") == 0 and told == [(1, 2)]
    e.load(docs.filter("doc_id >= 2").union(spark.createDataFrame([(2, "red Cow")], docs.schema)).filter("text IS NULL OR text <> 'red Cat'"))  # 2 anew
    assert e.build("text") == 3 and e.fields() == ["text"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(e.query_or("RED fish", "text")) == [1, 2, 3] and ids(e.query_and("red fish", "text")) == [1]
    assert ids(e.query_and_k("red fish", "text", 0.5)) == [1, 1, 2, 3] and ids(e.query_and_k("red fish", "text", 1)) == [1]
    assert ids(e.query_and_k_least("red fish", "text", 0.5)) == [1, 1, 1, 2, 3]
    assert ids(e.query_or_k("red fish", "text", 0.5)) == [1, 1, 2, 3] and ids(e.query_or_k_least("red fish", "text", 0.5)) == [1, 1, 1, 2, 2, 3, 3]
    assert ids(e.query("red fish", "text", QueryLevel.AT_OR)) == [1, 2, 3] and ids(e.query("red fish", "text", QueryLevel.AT_AND)) == [1]
    assert ids(e.query("red fish", "text", QueryLevel.AT_LEAST, 0.5)) == [1, 1, 1, 2, 3]
    assert e.top("fish", "text", 1).first().text.lower().endswith("fish") and [r.text for r in e.fetch([2]).collect()] == ["red Cow"]
    with pytest.raises(NotFound):
        e.query_or("nothing", "text")
    with pytest.raises(ValueError):
        e.build("title")
    assert ids(e.query_or("cow", "text")) == [2]  # what was loaded anew is found by its new text only
    with pytest.raises(NotFound):
        e.query_or("cat", "text")
    assert {r.doc_id: r.doc_type for r in e.ids().collect()} == {1: "first", 2: None, 3: None, 4: None} and rows(e.ids("first")) == [("first", 1)]
    assert {r.doc_type: r.docs for r in e.doc_types().collect()} == {"first": 1, None: 3}
    assert {r.doc_id: r.fields for r in e.document_fields().collect()} == {1: ["text"], 2: ["text"], 3: ["text"], 4: []}
    assert rows(e.stats) == [("text", 1, 8), ("text", 2, 7), ("text", 3, 9), ("text", 4, -1)]
    assert e.corpus("text").first() == (4, 23 / 4)
    before = rows(e.postings.drop("batch"))
    e.keep("text")
    assert e.postings.storageLevel.useMemory and rows(e.postings.drop("batch")) == before
    assert e.compact(force=True) and not e.compact() and rows(e.postings.drop("batch")) == before and ids(e.query_or("cow", "text")) == [2]
    assert e.build("text") == 0 and e.corpus("text").first() == (4, 23 / 4) and len(read_index(spark, e.path, "postings").collect()) == len(before)
    e.load(docs.filter("doc_id = 3"), "third")
    assert e.build("text") == 1 and ids(e.query_or("blue", "text")) == [3] and e.compact(0.9)
    many = " ".join(f"w{k}" for k in range(13)) + " red fish"
    assert ids(e.query_and_k_least(many, "text", 0.14)) == [1] and ids(e.query_or_k(many, "text", 0.14)) == [1, 2, 3] and rows(e.matching(many, "text", 2)) == [(1, 2)]
    scores = [r.group_score for r in e.query_or_k("red fish", "text", 0.5).collect()]
    assert scores == sorted(scores, reverse=True)


def test_plan_filters_postings_at_the_scan(spark, tmp_path):
    from skriva.sources import store

    store.write_postings(table(spark, ["a b", "b c"]), f"{tmp_path}/p")
    plan = Q.query_or(store.read_postings(spark, f"{tmp_path}/p"), ["a", "b"], "text")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(token, [a,b])]" in plan.replace("IsNotNull(token), ", "") and "PartitionFilters" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_parts_of_the_engine_can_be_replaced(spark, tmp_path):
    calls = []

    def loader(docs, path):
        calls.append("load")
        docs.coalesce(1).write.parquet(path)

    def ranker(postings, stats, tokens, groups=None, every=False, field=None, **options):
        found = Q.bm25(postings, stats, tokens, groups, every, field=field, **options)
        return found.withColumn("score", F.col("doc_id").cast("double"))

    e = SearchEngine(spark, str(tmp_path), loader=loader, ranker=ranker)
    e.load(spark.createDataFrame([(1, "red"), (2, "red"), (3, "red")], "doc_id long, text string"))
    assert e.build("text") == 3 and calls == ["load"]
    assert [(r.doc_id, r.score) for r in e.query_or("red", "text").collect()] == [(3, 3.0), (2, 2.0), (1, 1.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("gh"), st.integers(-300, 300)), min_size=1, max_size=30))
def test_group_score_is_the_discrete_median(spark, scores):
    ranked = spark.createDataFrame([(g, i, x / 1000) for i, (g, x) in enumerate(scores)], "token_group string, doc_id long, score double")
    want = {g: (len(own := sorted(x / 1000 for h, x in scores if h == g)), own[(len(own) - 1) // 2]) for g in {g for g, _ in scores}}
    assert {r.token_group: (r.docs, r.group_score) for r in Q.group_scores(ranked).collect()} == want


def test_no_query_reads_a_table_of_all_documents(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    e.load(spark.createDataFrame([(1, "red fish"), (2, "blue fish")], "doc_id long, text string"))
    e.build("text")
    plan = e.query_or("fish", "text")._jdf.queryExecution().executedPlan().toString()
    assert "/postings]" in plan and "/log]" not in plan and "/documents]" not in plan and "In(token" in plan or "EqualTo(token" in plan


def test_texts_are_moved_once(spark, tmp_path, monkeypatch):
    """Which documents are new is told by ids; only what a load holds beside new documents asks for a join of texts."""
    from skriva.streaming import build

    joined = []
    plain = build._texts
    monkeypatch.setattr(build, "_texts", lambda *a: joined.append("Join" in (t := plain(*a))._jdf.queryExecution().optimizedPlan().toString()) or t)
    e = SearchEngine(spark, str(tmp_path))
    docs = spark.createDataFrame([(i, f"red {i}") for i in range(6)], "doc_id long, text string")
    e.load(docs.filter("doc_id < 4"))
    e.build("text")
    e.load(docs.filter("doc_id > 2"))  # 3 anew
    e.build("text")
    assert joined == [False, False] and sorted(r.doc_id for r in e.query_or("red", "text").collect()) == list(range(6))
    e.load(docs.union(spark.createDataFrame([(7, "red long"), (7, "red longer"), (8, None)], docs.schema)))
    e.load(docs.filter("doc_id = 0").withColumn("text", F.lit("blue")))  # so that the load before has more than new documents
    assert e.build("text") == 8 and joined[2]
    assert sorted((r.doc_id, r.token) for r in e.postings.filter("token IN ('red', 'blue', 'long', 'longer')").collect()) == [(0, "blue"), *((i, "red") for i in range(1, 6)), (7, "longer"), (7, "red")]
    assert {r.doc_id: r.field_len for r in e.stats.collect()} == {0: 4, **{i: 5 for i in range(1, 6)}, 7: 10, 8: -1} and e.corpus("text").first().n == 8
    assert e.build("text") == 0 and len(joined) == 4
    want = rows(e.postings.drop("batch"))
    monkeypatch.setattr(build, "FEW_IDS", 1)  # too many to be sent to all tasks
    assert rows(e.postings.drop("batch")) == want and "ShuffledHashJoin" in e.postings._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(build, "TASK_ROWS", 2)
    assert e.compact(force=True) and rows(e.postings.drop("batch")) == want and rows(e.query_or("red", "text"))


def test_names_of_fields_are_shuffled_without_texts(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    e.load(spark.createDataFrame([(1, "red", None), (2, None, "t")], "doc_id long, text string, title string"), "a")
    e.load(spark.createDataFrame([(2, "blue", None)], "doc_id long, text string, title string"), "b")
    fields = e.document_fields()
    assert {r.doc_id: sorted(r.fields) for r in fields.collect()} == {1: ["text"], 2: ["text"]} and rows(e.ids("b")) == [("b", 2)]
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange") == 1
