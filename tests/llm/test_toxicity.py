import math

from hypothesis import given, settings
from hypothesis import strategies as st

from skriva.llm import toxicity as X

from . import edge

LEX = {"bad": 1.0, "worm": 1.5, "very bad": 2.0, "ugh*": 0.5}


def brute(text):
    """Every start and every term, one by one."""
    raw, low = X.fold(text)
    hits, excused = [], []
    for i in range(len(raw)):
        if i and raw[i - 1].isalnum():
            continue
        best = None
        spelt = [(x, w) for term, w in LEX.items() for x in (X.fold(term.rstrip("*"))[1] + "*" * term.endswith("*"), *X.variants(X.fold(term)[1]))]
        for term, w in spelt:
            key = term.rstrip("*")
            end = i + len(key)
            if low.startswith(key, i) and (term.endswith("*") or end == len(raw) or not raw[end].isalnum()):
                best = max(best or (0, 0), (w, end))
        if best:
            hits.append((i, best[1], best[0]))
        for p in ("not bad",):
            end = i + len(p)
            if low.startswith(X.fold(p)[1], i) and (end == len(raw) or not raw[end].isalnum()):
                excused.append((i, end))
    return [(s, e, w) for s, e, w in hits if not any(a <= s and e <= b for a, b in excused)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["bad", "very", "not", "ugh", "b4d", "ＢＡＤ", "bаd", "b​ad", "ugly", "w-o-r-m", "w o r m", "worrn", "worm", " ", " ", "x", "."]), max_size=12).map("".join))
def test_matches_are_those_of_brute_force(text):
    assert X.Matcher(LEX, ("not bad",)).matches(text) == brute(text)


def test_folding_and_scores():
    m = X.Matcher({"idiot": 1.0})
    for t in ("idiot", "IDIOT", "1d10t", "ıdіοt", "i​diot", "ídïöt", "𝐢𝐝𝐢𝐨𝐭"):
        assert m.score(f"you {t} there")[3], t
    assert not m.score("idiots")[1] and not m.score("xidiot")[1]
    assert m.score("idiot " + "word " * 400)[3] is False  # by length
    assert X.Matcher(X.LEXICON).score("take the trash can out")[1] == 0 and X.Matcher(X.LEXICON).score("you are trash")[3]
    assert m.score(None) == m.score("") == (0, 0, 0.0, False)
    assert X.Matcher({}, ()).score("anything") == (1, 0, 0.0, False)


def test_words_that_are_insults_only_of_people():
    m = X.Matcher(X.LEXICON)
    for clean in ("put the trash out", "Trash night is Tuesday", "vermin control", "the clown made the children laugh", "a bunch of flowers"):
        assert not m.score(clean)[3], clean
    for toxic in ("i d i o t", "what an i.d.i.o.t", "you rnoron", "m-o-r-o-n", "they are vermin", "human trash", "you are a stupid clown"):
        assert m.score(toxic)[3], toxic


def test_learned_terms_are_those_of_plain_counting(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = X.learn_lexicon(docs, labels)
    y = {}
    for r in labels.dropna().collect():
        y[r.doc_id] = max(y.get(r.doc_id, 0), r.toxic)
    seen = {}
    for r in docs.collect():
        if r.doc_id in y:
            for w in X.contexts(r.text):
                seen.setdefault(w, set()).add(y[r.doc_id])
    count = {}
    for w, ys in seen.items():
        c = count.setdefault(w.split("|")[0], [0, 0])
        c[0] += max(ys)
        c[1] += 1 - min(ys)
    odds = math.log(sum(b for _, b in count.values()) + 1) - math.log(sum(a for a, _ in count.values()) + 1)
    starts = {}
    for w, (a, b) in count.items():
        for n in X.BEGINNINGS:
            if len(w) > n:
                c = starts.setdefault(w[:n] + "*", [0, 0, 0])
                c[0], c[1], c[2] = c[0] + a, c[1] + b, c[2] + (a > 0)
    count |= {k: c[:2] for k, c in starts.items() if c[2] >= X.MIN_WORDS}
    want = {}
    for w, (a, b) in count.items():
        o = math.log(a + 0.5) - math.log(b + 0.5) + odds
        if a >= X.MIN_CONTEXTS and o >= X.MIN_LOG_ODDS:
            want[w] = a / (a + 4.0) * min(1.0, (o - 2) / 3)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_edge_cases(spark):
    docs = edge.table(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 0, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    for y in (labels, labels.filter("doc_id > 100"), labels.filter("toxic IS NULL")):
        m = X.fit(docs, y)
        rows = X.score_documents(docs, m).collect()
        assert len(rows) == len(edge.ROWS) and not any(r.toxic for r in rows)
        assert X.drop_toxic(docs, m).columns == docs.columns and X.drop_toxic(docs, m).count() == len(edge.ROWS)
    both = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int")  # the labels differ: toxic
    assert X.learn_lexicon(docs, both) == X.learn_lexicon(docs, both.filter("toxic = 1")) == {}
    assert X.score_documents(edge.empty(spark), X.fit(edge.empty(spark), labels)).count() == 0
    bad = spark.createDataFrame([(1, "you idiot " * 50_000), (2, "you idiot"), (2, "you idiot")], "doc_id long, text string")
    assert X.drop_toxic(bad, X.fit(bad, None)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = X.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = X.score_documents(docs, m).withColumnRenamed("toxic", "got").join(labels.filter("doc_id % 2 = 1").select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.got and r.toxic == 1 for r in rows)
    wrong, missed = sum(r.got and r.toxic == 0 for r in rows), sum(not r.got and r.toxic == 1 for r in rows)
    assert hit / (hit + missed) > 0.9 and wrong < 0.01 * len(rows)
