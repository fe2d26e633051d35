import pytest
from pyspark.sql import functions as F

from skriva.operators import dictionary as D
from skriva.operators import index as I
from skriva.schema import KeyExists, NotFound
from skriva.sources import loaders, store
from skriva.streaming.build import build_batch, document_stream, read_index, stream_build

DOCS = [(1, "a b a"), (2, "b c"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_postings(docs):
    assert rows(I.postings(docs)) == [("text", "a", 1, 2), ("text", "b", 1, 1), ("text", "b", 2, 1), ("text", "c", 2, 1)]
    assert {r.tf for r in I.postings(docs, binary_tf=True).collect()} == {1}
    assert rows(I.vocabulary(I.postings(docs))) == [("text", "a", 1, 2), ("text", "b", 2, 2), ("text", "c", 1, 1)]
    assert rows(I.doc_stats(docs)) == [("text", 1, 5), ("text", 2, 3), ("text", 3, -1), ("text", 4, 0)]
    assert rows(I.posting_map(I.postings(docs)).filter("token = 'b'"))[0][2] == {1: 1, 2: 1}
    assert rows(I.term_frequency(I.postings(docs), "a", docs)) == [(1, 2), (2, 0), (3, 0), (4, 0)]
    assert I.postings(docs.filter("doc_id > 9")).count() == 0


def test_unknown_field(docs):
    with pytest.raises(ValueError):
        I.postings(docs, "nothing")
    assert I.field_column(docs, "Text") == "text"


def test_incremental_equals_full(docs):
    first = docs.filter("doc_id < 2")
    log = first.select(F.lit("text").alias("field"), "doc_id", F.lit(1).alias("batch_id"))
    assert rows(I.postings(first).union(I.postings(I.unbuilt(docs, log, "text")))) == rows(I.postings(docs))
    assert rows(I.merge_postings(I.postings(docs), I.postings(docs))) == [(f, t, d, 2 * n) for f, t, d, n in rows(I.postings(docs))]


def test_store_and_compaction(spark, docs, tmp_path):
    post, path = I.postings(docs), f"{tmp_path}/p"
    for k in range(3):
        store.write_postings(post.withColumn("tf", F.col("tf") + 2 - k), f"{path}/generation={k}")
    store.write_postings(spark.createDataFrame([("text", "old", 9, 4)], post.schema), f"{path}/generation=0")
    assert round(store.live_ratio(store.read_postings(spark, path)), 3) == 0.385
    assert store.compact(spark, path, f"{tmp_path}/q")
    assert rows(store.read_postings(spark, f"{tmp_path}/q")) == sorted([*rows(post), ("text", "old", 9, 4)])  # the newest record of each
    assert not store.compact(spark, f"{tmp_path}/q", f"{tmp_path}/r")
    store.write_documents(docs, f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    assert rows(store.fetch(stored, [2, 9])) == [(2, "b c")] and store.fetch_all(stored, post).count() == 2


def test_stored_files_have_bloom_filters(spark, docs, tmp_path):
    """The footers tell where the filters are, by the library that Spark itself reads with."""
    many = spark.range(5000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    store.write_documents(many, f"{tmp_path}/d")
    store.write_postings(I.postings(many), f"{tmp_path}/p")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder, column in (("d", "doc_id"), ("p", "token")):
        for f in (tmp_path / folder).rglob("*.parquet"):
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            for block in reader.getFooter().getBlocks():
                found = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()}
                assert found[column] > 0
            reader.close()


def test_fields_of_documents(spark, docs):
    assert {r.doc_id: r.fields for r in I.document_fields(docs).collect()} == {1: ["text"], 2: ["text"], 3: [], 4: ["text"]}


def test_texts_in_one_file_are_analyzed_by_all_tasks(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word', id % 7, ' and more') AS text").coalesce(1)
    spread = I.postings(docs)
    assert spread.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan  # of texts; tokens are counted where they are
    assert min(spread.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()) > 500


def test_stream_build_counts_each_document_once(spark, docs, tmp_path):
    source = f"{tmp_path}/in"
    docs.repartition(3, "doc_id").write.parquet(source)
    stream_build(document_stream(spark, source, docs.schema, 1), f"{tmp_path}/i", f"{tmp_path}/c").awaitTermination()
    docs.write.mode("append").parquet(source)  # the same documents again
    stream_build(document_stream(spark, source, docs.schema, 1), f"{tmp_path}/i", f"{tmp_path}/c").awaitTermination()
    short = lambda df: rows(df.drop("field_len", "batch"))
    assert short(read_index(spark, f"{tmp_path}/i", "postings")) == rows(I.postings(docs))
    assert read_index(spark, f"{tmp_path}/i", "log").count() == 4
    build_batch(docs, 1, f"{tmp_path}/i2")
    build_batch(docs, 1, f"{tmp_path}/i2")  # a batch that runs again replaces itself
    assert short(read_index(spark, f"{tmp_path}/i2", "postings")) == rows(I.postings(docs))


def test_stream_by_interval_tells_of_its_batches(spark, docs, tmp_path):
    """The timer of the stream persists each batch by itself."""
    import time

    source, told = f"{tmp_path}/in", []
    docs.coalesce(1).write.parquet(source)
    running = stream_build(document_stream(spark, source, docs.schema, 1), f"{tmp_path}/i", f"{tmp_path}/c", interval="1 second", done=lambda batch, n: told.append((batch, n)))
    try:
        until = time.time() + 90
        while not told and time.time() < until:
            time.sleep(0.2)
    finally:
        running.stop()
    assert told == [(1, 4)] and read_index(spark, f"{tmp_path}/i", "log").count() == 4


def test_dictionary(spark):
    terms = spark.createDataFrame([("apple", 1), ("app", 2), ("as", 3), ("ass", 4), ("axp", 4)], "token string, id int")
    assert rows(D.exact(terms, "apple")) == [("apple", 1)] and D.exact(terms, "ap").count() == 0
    assert [t for t, _ in rows(D.prefix(terms, "ap"))] == ["app", "apple"]
    assert [t for t, _ in rows(D.prefix(terms, "app"))] == ["apple"] and D.prefix(terms, "app", inclusive=True).count() == 2
    assert D.prefix(terms, "a").count() == 5
    assert [t for t, _ in rows(D.between(terms, "apple", "ass"))] == ["apple", "as", "ass"] and D.between(terms, "apple", "ass", upper=False).count() == 2
    assert D.term_records(spark.createDataFrame([("x", 5), ("x", 3), ("y", 1)], "suffix string, id long")).orderBy("suffix").collect() == [("x", 3, 1), ("y", 1, 0)]


def test_key_value_changes(spark):
    table = spark.createDataFrame([(i, str(i)) for i in range(20)], "token long, value string")
    one = lambda k, v: spark.createDataFrame([(k, v)], "token long, value string")
    with pytest.raises(KeyExists):
        D.insert(table, one(3, "x"))
    with pytest.raises(NotFound):
        D.update(table, one(99, "x"))
    table = D.update(D.delete(table, spark.createDataFrame([(0,), (2,)], "token long")), one(18, "19"))
    assert table.count() == 18 and rows(D.exact(table, 18)) == [(18, "19")] and rows(D.insert(table, one(0, "z")).filter("token = 0")) == [(0, "z")]
    merged = D.upsert_with(one(1, "a").union(one(2, "b")), one(2, "c").union(one(3, "d")), "value", F.concat("old", "new"))
    assert rows(merged) == [(1, "a"), (2, "bc"), (3, "d")]


def test_bloom(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string")
    bloom = D.bloom_merge(D.bloom_build(keys.limit(100), "k"), D.bloom_build(keys, "k"))
    other = spark.createDataFrame([(f"n{i}",) for i in range(200)], "k string")
    found = {r.k: r.found for r in D.bloom_test(keys.union(other), "k", bloom).collect()}
    assert all(found[f"k{i}"] for i in range(200)) and sum(found[f"n{i}"] for i in range(200)) <= 1


def test_news_loader(spark, tmp_path):
    for kind, name, text in (("sport", "1", "Title one\nbody\nmore"), ("local news+", "2", "Only title"), ("sport", "3", "")):
        (tmp_path / "in" / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / kind / f"{name}.txt").write_text(text)
    got = loaders.read_news_texts(spark, f"{tmp_path}/in")
    want = [("local news+", "Only title", ""), ("sport", "Title one", "\nbody\nmore")]
    assert rows(got.drop("doc_id")) == want
    loaders.write_news_xml(got.filter("title <> ''"), f"{tmp_path}/xml")
    back = loaders.read_news_xml(spark, f"{tmp_path}/xml")
    assert rows(back.filter("title = 'Title one'").drop("doc_id")) == [want[1]]
    assert loaders.latest(got.withColumn("doc_id", F.lit(1)), F.length("content")).count() == 1


def test_wiki_loader(spark, tmp_path):
    import gzip

    xml = '<feed><doc><title>T2</title><url>http://x</url><abstract>abc</abstract><links><sublink linktype="menu"><anchor>A</anchor><link>http://x#A</link></sublink></links></doc></feed>'
    with gzip.open(tmp_path / "w.xml.gz", "wt") as f:
        f.write(xml)
    r = loaders.read_wiki_xml(spark, str(tmp_path / "w.xml.gz")).first()
    assert (r.title, r.url, r.abstract) == ("T2", "http://x", "abc") and r.sublinks[0].asDict() == {"linktype": "menu", "anchor": "A", "link": "http://x#A"}


def test_broken_rows_are_left_out_and_can_be_had(spark, tmp_path):
    good = "<doc><title>T1</title><url>u</url><abstract>a</abstract></doc>"
    (tmp_path / "w.xml").write_text(f"<feed>{good}<doc><title>T2</titel></doc><doc><title>T3</title><url>v</url></doc></feed>")
    assert sorted(r.title for r in loaders.read_wiki_xml(spark, str(tmp_path / "w.xml")).collect()) == ["T1", "T3"]
    broken = loaders.broken_rows(spark, str(tmp_path / "w.xml")).collect()
    assert len(broken) == 1 and broken[0].record.startswith("<doc><title>T2")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        loaders.read_wiki_xml(spark, str(tmp_path / "w.xml"), strict=True).collect()


def test_no_task_grows_with_the_input(spark, tmp_path, monkeypatch):
    """More tasks for more documents or records, whatever the session's number of shuffle partitions."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 7, ' and more') AS text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(I, "TASK_BYTES", 1000)
    assert I.postings(stored).rdd.getNumPartitions() > 2 * few
    for k in range(2):
        store.write_postings(I.postings(stored), f"{tmp_path}/p/generation={k}")
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    newest = store.newest(spark, f"{tmp_path}/p")
    assert newest.rdd.getNumPartitions() == 36 and newest.count() == 9000  # 18,000 records
    monkeypatch.setattr(store, "TASK_BYTES", 1000)
    store.write_documents(stored, f"{tmp_path}/e")
    assert len(list((tmp_path / "e").glob("*.parquet"))) > 2 * few
    assert store.compact(spark, f"{tmp_path}/p", f"{tmp_path}/q", force=True) and rows(store.read_postings(spark, f"{tmp_path}/q")) == rows(I.postings(docs))
    for f in (tmp_path / "q").rglob("*.parquet"):
        own = [(r.token, r.doc_id) for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)


def test_news_texts_are_written_in_place_and_read_by_few_tasks(spark, tmp_path):
    docs = spark.range(90).selectExpr("concat('by ', id % 3) AS category", "concat('Title ', id, '\\n中 body') AS value").coalesce(1)
    loaders.write_news_texts(docs, f"{tmp_path}/t")
    files = [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    assert len(files) == 90 and {p.suffix for p in files} == {".txt"} and {p.parent.name for p in files} == {"by 0", "by 1", "by 2"}
    read = loaders.read_news_texts(spark, f"{tmp_path}/t")
    assert rows(read.drop("doc_id")) == sorted((f"by {i % 3}", f"Title {i}", "\n中 body") for i in range(90))
    assert read.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    with pytest.raises(FileExistsError):
        loaders.write_news_texts(docs, f"{tmp_path}/t")
    with pytest.raises(Exception, match="no name of a folder"):
        loaders.write_news_texts(docs.withColumn("category", F.lit("a/b")), f"{tmp_path}/u")
