import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skriva.llm import decontaminate as C

from . import edge


def machine(patterns):
    ends = np.cumsum([len(p) for p in patterns], dtype=np.int64)
    return C.WuManber(b"".join(patterns), ends - [len(p) for p in patterns], ends)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), min_size=1, max_size=6), st.text("ab ", max_size=200))
def test_search_finds_what_naive_search_finds(patterns, text):
    patterns, data = [p.encode() for p in dict.fromkeys(patterns)], text.encode()
    want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))
    assert sorted(machine(patterns).find(data)) == want


def test_search_over_many_lanes():
    data = (b"x" * 511 + b"needle-needle" + b"y" * 700) * 9
    got = machine([b"needle-needle", b"needle"]).find(data)
    assert sorted(got) == sorted((i, k) for k, p in enumerate([b"needle-needle", b"needle"]) for i in range(len(data)) if data.startswith(p, i))
    for bad in ([], [b""]):
        with pytest.raises(ValueError):
            machine(bad)


def brute(docs, items):
    import re

    norm = lambda t: re.sub(r"[^\w]+|_+", " ", t.lower()).split()
    out = {}
    for d, text in docs:
        for b, item in items:
            w, t = norm(item), norm(text)
            n = min(C.WINDOW, len(w))
            have = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n >= C.LEAST or n == len(t) else set()
            own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            if own & have:
                out[d, b] = len(own & have), len(own)
    return out


def test_against_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:20])), (2, "Short, ITEM here, of six words"), (6, "word"), (3, "!!!"), (4, " ".join(words[30:43])), (5, " ".join(words[:20]))]
    docs = [(1, "zz " + " ".join(words[3:17]).upper()), (2, "a short item; here of SIX words"), (3, "short itemhere of six words"), (7, "Word."), (8, "a word more"), (4, "... " + " ... ".join(words[30:43])), (5, " ".join(words[3:15])), (6, "x " * 100_000 + " ".join(words))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (C.MAX_BYTES, 60):  # one pass, and several
        got = {(r.doc_id, r.item_id): (r.matched_windows, r.item_windows) for r in C.find_contamination(d, b, max_bytes=size).collect()}
        assert got == brute(docs, items)
        assert {r.doc_id for r in C.drop_contaminated(d, b, max_bytes=size).collect()} == {3, 5, 8}


def test_edge_cases(spark):
    docs = edge.table(spark)
    items = spark.createDataFrame([(1, "a plain sentence about gardens", 1), (None, None, 2), (2, "", 3), (None, "a row without an id", 4)], "item_id long, text string, f int")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in C.find_contamination(docs, items).collect())
    assert got == [("1", "1"), ("2", "1"), ("None", "None")]
    kept = C.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(edge.ROWS) - 4
    assert C.find_contamination(edge.empty(spark), items).count() == 0 and C.find_contamination(docs, items.filter("item_id = 9")).count() == 0
    assert C.drop_contaminated(docs, items.filter("item_id = 9")).count() == len(edge.ROWS)


def test_query_is_its_sql(spark):
    con, path = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{path}/{t}.parquet'")
    want = sorted(con.execute(C.SQL).fetchall())
    got = C.query(spark, path).select("doc_id", "item_id", "matched_windows", "item_windows").collect()
    assert sorted(map(tuple, got)) == want and want


def test_rows_of_one_id_are_one_document_as_in_the_sql(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    words = item.split()
    docs = [(1, " ".join(words[:15])), (1, " ".join(words[10:26])), (1, " ".join(words[:15])), (2, "one"), (3, "one two"), (4, ""), (5, None)]
    items = [(1, item), (1, " ".join(words[5:22])), (2, "One"), (3, "one two three four five")]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = C.query(spark, str(tmp_path)).select("doc_id", "item_id", "matched_windows", "item_windows").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(C.SQL).fetchall()) == [(1, 1, 7, 18), (2, 2, 1, 1)]
