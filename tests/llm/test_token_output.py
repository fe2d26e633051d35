from pathlib import Path

from pyarrow import orc

from skriva.llm import token_output as T

from . import edge


def test_round_trip_and_edge_cases(spark, tmp_path):
    docs = edge.table(spark)
    out = T.write_tokens(docs, f"{tmp_path}/t")
    assert out.columns == ["doc_id", "n_tokens", "tokens"]
    decode = T.encoding().decode
    got = [(str(r.doc_id), None if r.tokens is None else decode(r.tokens)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((str(i), t) for i, t, *_ in edge.ROWS), key=str)
    assert all(r.n_tokens == len(r.tokens or []) for r in out.collect())
    nothing = T.write_tokens(edge.empty(spark), f"{tmp_path}/n")
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_ids_are_those_of_the_plain_encoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: T.encoding().encode_ordinary(r.text) for r in docs.collect()}
    assert {r.doc_id: list(r.tokens) for r in T.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_lookup_and_file_layout(spark, tmp_path):
    docs = spark.range(6000).selectExpr("id * 7 AS doc_id", "repeat(concat('token ', id, ' '), 40) AS text").repartition(2)
    T.write_tokens(docs, f"{tmp_path}/t")
    assert sorted(r.doc_id for r in T.lookup(spark, f"{tmp_path}/t", [7, 8, 700]).collect()) == [7, 700]
    files = list(Path(f"{tmp_path}/t").glob("*.orc"))
    assert len(files) == 2
    for f in files:
        o = orc.ORCFile(f)
        assert o.row_index_stride == T.ROW_STRIDE and o.compression == "ZSTD"
        ids = o.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        assert sum(o.read_stripe(k, ["doc_id"]).num_rows for k in range(o.nstripes)) == len(ids)  # stripes read apart
    # the row groups' Bloom filters, by Spark's own ORC library
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    kinds = [(s.getColumn(), s.getKind().toString()) for s in streams]
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and not any(c != 1 and k.startswith("BLOOM") for c, k in kinds)


def test_runs_of_any_length(spark):
    """Runs that the pattern's engine can't go through, beside the ids of a pattern engine without that bound."""
    import regex

    pieces = regex.compile(T.PATTERN)

    def plain(text):
        return [i for m in pieces.finditer(text) for i in T.encoding()._encode_single_piece(m.group())]

    n = 1_000_000
    texts = [" " * n, "a" + " " * n + "b", "\n" * n + "x", " \n" * (n // 2) + " \t", "1" * n, "é" * n, "a b" + " " * 70_000 + "c  d" + "\u3000" * 70_000 + "!" + " " * 3]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.tokens for r in T.tokenize(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain(t), k
    assert T.encode("a  b").tolist() == plain("a  b")
