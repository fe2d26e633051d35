import zstandard

from skriva.llm import langid as L

from . import edge

EN, DE = "the house and the garden of the old man with a dog ", "das haus und der garten von dem alten mann mit dem hund "


def model(**kw):
    return L.Classifier({"en": L.normalise(EN * 3), "de": L.normalise(DE * 3)}, **kw)


def test_sizes_are_those_of_plain_compression():
    m = model()
    data = L.normalise("the dog and the man " * 200)
    for raw, size in zip(m.raw, m.sizes(data)):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
        assert size == sum(len(packer.compress(data[i : i + L.PIECE])) for i in range(0, len(data), L.PIECE))


def test_choice_rejection_and_ties():
    m = model()
    assert m.classify("the old man and the dog of the garden")[0] == "en" and m.classify("der alte mann und das haus mit dem garten")[0] == "de"
    assert m.classify(None) == m.classify("") == m.classify("123 !") == (None, None, None, False)
    same = L.Classifier({"a": b"same text here", "b": b"same text here"})
    assert same.classify("same text here") [0] == "a" and same.classify("same text here")[3] is False
    assert L.Classifier({"en": b"x"}).classify("some words")[3] is False and L.Classifier({}).classify("some words")[3] is False
    assert model(margin=0.99).classify("the old man")[3] is False


def test_edge_cases(spark):
    docs = edge.table(spark)
    rows = L.identify(docs, L.fit(docs)).collect()
    assert len(rows) == len(edge.ROWS) and rows[0] == rows[1]
    by = {r.doc_id: r for r in rows}
    assert by[3].predicted is None and by[4].predicted is None and by[8].predicted is None and not by[3].accepted
    assert by[5].compressed_bytes > 0
    assert L.identify(edge.empty(spark), L.fit(edge.empty(spark))).count() == 0
    assert L.identify(docs, L.Classifier({})).filter("predicted IS NOT NULL").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 100")
    m = L.fit(docs.filter("doc_id % 2 = 0"))
    rows = L.identify(docs.filter("doc_id % 2 = 1"), m).withColumnRenamed("lang", "got").join(docs.select("doc_id", "lang"), "doc_id").collect()
    taken = [r for r in rows if r.accepted]
    assert len(taken) > 0.8 * len(rows)
    assert sum(r.got == r.lang for r in taken) > 0.97 * len(taken)


def test_dictionaries_hold_a_share_of_every_text():
    texts = ["aa " * 5, "bb " * 3000, "cc " * 9000, "", "d" * 100]
    own = L.dictionary(texts, 4000)
    assert 3900 < len(own) <= 4000 and own.count(b"aa") == 5 and own.count(b"d") == 100
    assert abs(own.count(b"bb") - own.count(b"cc")) < 20
    long = b"".join(b"%06d" % k for k in range(10_000))
    part = L.spread(long, 1000)
    places = [int(part[i : i + 6]) for i in range(0, 200, 6)]
    assert len(part) <= 1000 and part[:6] == b"000000" and part[-6:] == b"009999" and places
    assert L.spread(b"abc", 3) == b"abc" and L.spread(b"abc", 0) == b"" and L.dictionary([]) == b""


def test_query_is_plain_compression_against_dictionaries_of_the_sample(spark):
    """Fit and query, both by plain loops over the rows."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = docs.selectExpr("*", "xxhash64(doc_id) AS h").collect()
    dictionaries = {}
    for lang in {r.lang for r in rows} - {None}:
        sample = sorted((r.h, r.doc_id, r.text) for r in rows if r.lang == lang and r.text is not None)[: L.MAX_SAMPLE]
        dictionaries[lang] = L.dictionary([t for *_, t in sample])
    want = {}
    for r in rows:
        data, sizes = L.normalise(r.text or ""), {}
        for lang, raw in dictionaries.items():
            packer = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            sizes[lang] = sum(len(packer.compress(data[i : i + L.PIECE])) for i in range(0, len(data), L.PIECE))
        (best, lang), (after, _) = sorted((n, k) for k, n in sizes.items())[:2]
        margin = (after - best) / after
        want[r.doc_id] = (lang if margin >= L.MARGIN else None, lang, round(margin, 6), best, margin >= L.MARGIN) if data else (None, None, None, None, False)
    assert {r.doc_id: tuple(r)[1:] for r in L.query(spark, path).collect()} == want
    many = spark.range(900).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text", "concat('l', id % 300) AS lang")
    assert len(L.fit(many).languages) == 300
