"""A table with everything awkward, shared by the operators' tests."""

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000  # 1.2 MB
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, h string, r int, t string, k string, key string, hi long, lo long, __gone long, __n int, __slot long, __k string, __key string, score double, tokens int, slot int, block int, id long, TEXT string, Doc_Id string, Source string, Lang string"
EXTRA = ("x", "h", 7, "t", "k", "key", 1, 2, 3, 4, 5, "k", "key", 0.5, 6, 7, 8, 9, "other TEXT", "other", "other", "other")
ROWS = [
    (1, "A plain sentence about gardens and rivers.", "en", "a"),
    (1, "A plain sentence about gardens and rivers.", "en", "a"),
    (2, "A plain sentence about gardens and rivers.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, LONG, "en", "a"),
    (6, " \n\t ", None, "b"),
    (7, "日本語 текст 🙂 \u0000 end", "xx", None),
    (8, "1234 !!! ???", "en", "c"),
    (None, "A row without an id", "en", "a"),
    (None, None, None, None),
]


def table(spark):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *EXTRA) for i, t, g, s in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
