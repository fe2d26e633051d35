from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from skriva.llm import simhash as H
from skriva.llm.common import session_conf

from . import edge


def brute_pairs(prints, radius):
    return sorted((a, b) for (a, x, y), (b, z, w) in combinations(prints, 2) if ((x ^ z) & (2**64 - 1)).bit_count() + ((y ^ w) & (2**64 - 1)).bit_count() <= radius)


def brute_groups(nodes, pairs):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("m", H.SEGMENTS)
def test_search_is_exact(spark, m):
    rng, prints = np.random.default_rng(m), []
    for base in rng.integers(-(2**63), 2**63, (12, 2)):
        for k in range(6):
            x = [int(v) for v in base]
            for bit in rng.choice(128, 3 * k, replace=False):
                x[bit // 64] ^= 1 << int(bit % 64)
            prints.append(tuple((v + 2**63) % 2**64 - 2**63 for v in x))
    rows = [(i, *p) for i, p in enumerate(dict.fromkeys(prints))]
    df = spark.createDataFrame(rows, "node long, hi long, lo long")
    for n in (1 << 20, 1 << 30):  # with fewer and more upper bits
        with session_conf(spark, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            found = H.near_pairs(df, m, n=n)
            got = found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got)) == brute_pairs(rows, H.RADIUS) and len(got) > 50
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning") == 2  # the balls' lower bits are enumerated behind the exchange
    assert sorted(map(tuple, H.pairs_of(df).collect())) == brute_pairs(rows, H.RADIUS)


def test_layouts_cover_every_bit(spark):
    for m in H.SEGMENTS:
        for radius in (*range(4, 17), 31):
            parts = H.layout(m, radius)
            assert sum(w for _, w, _ in parts) == 128 and len(parts) == m and all(a + w == b for (a, w, _), (b, _, _) in zip(parts, parts[1:]))
            # more bits in every segment than are looked for make more than the radius
            assert sum(r + 1 for *_, r in parts) > radius
    for x, y in ((-1, 5), (2**62 + 7, -(2**63)), (0, 12345678901234)):
        whole = (x % 2**64) << 64 | y % 2**64
        row = spark.createDataFrame([(x, y)], "hi long, lo long")
        for m in H.SEGMENTS:
            assert list(row.select(*[H.segment("", p).alias(f"s{k}") for k, p in enumerate(H.layout(m))]).first()) == [whole >> a & (1 << w) - 1 for a, w, _ in H.layout(m)]
    assert len(H.masks(5, 2)) == 1 + 5 + 10
    assert H.choose_segments(10) >= H.choose_segments(10**12)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(60)]  # and a chain
    got = {r.node: r.label for r in H.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_groups({x for e in edges for x in e}, edges)
    assert H.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [(r.doc_id, *f) for r in docs.select("doc_id", "text").collect() if (f := H.fingerprint(r.text))]
    want = brute_groups([p[0] for p in prints], brute_pairs(prints, H.RADIUS))
    rows = H.query(spark, "/root/testdata/sf0.01").collect()
    got = {r.doc_id: (r.group_id, r.keep) for r in rows}
    links = Counter(x for p in brute_pairs(prints, H.RADIUS) for x in p)
    assert all(r.links == links[r.doc_id] for r in rows) and max(links.values()) > 3
    assert {d: g for d, (g, _) in got.items() if d in want} == want
    assert all(keep == (d == g) for d, (g, keep) in got.items()) and len(got) == docs.count()


def test_planted_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    docs, truth = [], {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(3 if i < 10 else 1):
            copy = list(w)
            for at in rng.choice(len(w), 3 * k, replace=False):
                copy[at] = str(rng.choice(words))
            docs.append((100 * i + k, " ".join(copy)))
            truth[100 * i + k] = 100 * i
    got = {r.doc_id: r.group_id for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == truth


def test_edge_cases(spark):
    docs = edge.table(spark)
    rows = H.near_duplicates(docs).collect()
    assert len(rows) == len(edge.ROWS) and H.near_duplicates(docs).columns == ["doc_id", "group_id", "links", "keep"]
    by = {r.doc_id: r for r in rows}
    assert by[1].group_id == by[2].group_id == 1 and by[1].links == by[2].links == 2 and not by[2].keep and all(by[i].keep for i in (1, 3, 4, 5, 6, 7, 8))
    assert by[3].group_id == 3 and by[3].links == 0 and [r.group_id for r in rows if r.doc_id is None] == [None, None]
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    # rows that share an id count by their texts; copies without an id are copies
    same = spark.createDataFrame([(1, "red apples and green pears"), (1, "something else entirely, of seven words"), (None, "red apples and green pears"), (None, "red apples and green pears"), (None, "red apples and green pears!"), (2, "SOMETHING else entirely of seven words"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(map(str, H.drop_near_duplicates(same).collect())) == sorted(map(str, [same.collect()[i] for i in (0, 1, 6, 7)]))
    assert sorted((r.group_id or 0, r.links, r.keep) for r in H.near_duplicates(same).collect()) == [(1, 1, False), (1, 1, True), (1, 3, False), (1, 3, False), (1, 3, False), (1, 3, True), (3, 0, True), (3, 0, True)]
    assert H.near_duplicates(edge.empty(spark)).count() == 0 and H.drop_near_duplicates(edge.empty(spark)).count() == 0


def test_many_equal_documents_are_one_entry(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the very same text here' AS text")
    assert [tuple(r) for r in H.near_duplicates(docs).groupBy("group_id").count().collect()] == [(0, 3000)]
    assert H.drop_near_duplicates(docs).count() == 1
    again = docs.union(docs).union(docs)
    assert H.drop_near_duplicates(again).collect() == [(0, "the very same text here")]
