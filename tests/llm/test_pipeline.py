from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skriva.llm import decontaminate, mixing, simhash, token_output, toxicity

from . import edge

PATH = "/root/testdata/sf0.001"


def test_stages_follow_each_other_by_brute_force(spark):
    """Every stage on what the stage before it kept, against a plain loop."""
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels, items = (spark.read.parquet(f"{PATH}/{t}.parquet") for t in ("labels", "benchmark"))
    left = {r.doc_id: r.text for r in docs.collect()}
    matcher = toxicity.fit(docs, labels)
    left = {i: t for i, t in left.items() if not matcher.score(t)[3]}
    prints = {i: simhash.fingerprint(t) for i, t in left.items()}
    group = {i: i for i in left}
    near = [(a, b) for a in prints for b in prints if a < b and prints[a] and prints[b] and sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b])) <= simhash.RADIUS]
    for _ in range(len(near) + 1):
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    left = {i: t for i, t in left.items() if group[i] == i}
    kept = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    dirty = {r.doc_id for r in decontaminate.find_contamination(kept, items).collect()}
    left = {i: t for i, t in left.items() if i not in dirty}
    out = P.run(spark, PATH).collect()
    assert {r.doc_id for r in out} == set(left)
    # pieces as the plain cutting of the shuffled documents has them, in as many slots as the schedule gives them
    mixed = spark.read.parquet(f"{PATH}/documents.parquet").filter(F.col("doc_id").isin(list(left)))
    want = Counter()
    for r in mixing.schedule(mixed).collect():
        cuts = [m.start() for m in mixing._TOKEN.finditer(left[r.doc_id])]
        begin = 0 if not r.first_token else cuts[r.first_token]
        end = cuts[r.first_token + r.tokens] if r.first_token + r.tokens < len(cuts) else None
        want[r.doc_id, tuple(token_output.encoding().encode_ordinary(left[r.doc_id][begin:end]))] += 1
    assert Counter((r.doc_id, tuple(r.tokens)) for r in out) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    assert len(P.STAGES) == 5
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, PATH).columns == docs.columns


def test_tokens_keep_the_order_of_the_schedule(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    want = [r.doc_id for r in mixing.schedule(docs).withColumn("key", mixing._key("doc_id", "source", mixing.SEED)).orderBy("slot", "key", "first_token").collect()]
    assert len(want) > len(set(want))  # some repeat
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")  # files are split, and read in another order
    try:
        path, again = f"{tmp_path}/mixed", f"{tmp_path}/tokens"
        P.mixed(spark, docs, PATH).write.option("maxRecordsPerFile", "50").parquet(path)
        P.token_ids(spark, spark.read.parquet(path), PATH).write.parquet(again)
        rows = spark.read.parquet(again).select("doc_id", "position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.position for r in rows}) == len(rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_cases(spark, tmp_path, k):
    stage = P.STAGES[k][1]
    for make in (edge.table, edge.empty):
        docs = make(spark)
        out = stage(spark, docs, PATH)
        n = out.count()
        assert n >= (len(edge.ROWS) - 2 if make is edge.table else 0) and (make is edge.table or n == 0)
        assert k == 4 or out.columns == docs.columns
