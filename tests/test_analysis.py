import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skriva.functions.tagging import DictionaryTagger
from skriva.operators import filters as T
from skriva.operators import tokenize as K
from skriva.operators.dictionary_data import dictionary, read_dictionary, words
from skriva.operators.index import Analyzer


def run(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def brute_tokens(text):
    out = []
    for field in re.split(r"[\s\x85]+", text):
        start = 0
        for i, c in enumerate(field):
            if i > start and not (c.isalnum() and not re.match(r"[^\w]", c)):
                out.append(field[start:i])
                start = i
        if field[start:]:
            out.append(field[start:])
    return out


def test_tokenizer_fixtures(spark):
    assert run(spark, "source:xinhua foo. --a", K.english) == ["source", ":xinhua", "foo", ".", "-", "-a"]
    assert run(spark, "source:xinhua foo.", lambda t: K.english(t, True)) == ["source", "xinhua", "foo"]
    assert [tuple(x) for x in run(spark, "source:xinhua foo a-b-c", K.english_positions)] == [(0, "source", 0), (2, "a", 0), (2, "-b", 1)]
    for text in (None, "", " \n\t"):
        assert run(spark, text, K.english) == [] and run(spark, text, K.english_positions) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab Z9.-:\n中é", max_size=30))
def test_tokenizer_property(spark, text):
    assert run(spark, text, K.english) == brute_tokens(text)


def test_positions_in_a_field_of_very_many_pieces(spark):
    for n in (511, 512, 513, 514, 20_000):
        text = "-".join("ab" for _ in range(n))
        got = run(spark, f"x:y {text}", K.english_positions)
        assert [tuple(r) for r in got] == [(0, "x", 0)] + [(1, "-ab" if k else "ab", 3 * k - (k > 0)) for k in range(n - 1)], n


def test_english_filters(spark):
    assert run(spark, "HELLO! THIS Is My Dog", lambda t: T.lowercase(F.array(t))) == ["hello! this is my dog"]
    assert run(spark, "cat cats fish fishing fished airline", lambda t: T.stems(K.english(t))) == "cat cat fish fish fish airlin".split()
    assert run(spark, "i am the cat", lambda t: T.stop_words()(K.english(t))) == ["cat"]
    assert run(spark, "A nouns is a word", lambda t: T.nouns()(K.english(t))) == ["nouns", "word"]
    assert run(spark, "a bc", lambda t: T.min_length(2)(K.english(t))) == ["bc"]
    assert run(spark, None, lambda t: T.stems(K.english(t))) == []


def test_english_pipeline(spark):
    """The published example: lower case comes first, so that no name is a proper noun."""
    text = "The school is located in the old revolutionary base areas in the Dabie Mountains"
    assert run(spark, text, Analyzer(filters=(T.lowercase, T.nouns(), T.stop_words()))) == ["school", "base", "dabie", "mountains"]
    assert run(spark, text, Analyzer(filters=(T.lowercase, T.nouns(), T.stop_words(), T.stems))) == ["school", "base", "dabi", "mountain"]


def test_chinese_pipeline(spark):
    """The published example."""
    text = "据中央气象台网站消息，受弱冷空气影响，21日夜间至23日，新疆、内蒙古西部和东北部、青海北部、甘肃西部、东北地区等地的部分地区将有4～6℃降温"
    want = ["中央气象台网站", "弱冷空气", "新疆", "内蒙古", "青海", "甘肃", "东北地区", "部分地区", "降温"]
    assert run(spark, text, Analyzer("zh", filters=(T.chinese_nouns(drop_last=True),))) == want
    assert run(spark, "我们在北京的大学学习，他喜欢音乐。", Analyzer("zh", filters=(T.chinese_nouns(),))) == ["北京", "大学学习", "音乐"]
    assert run(spark, "", Analyzer("zh", filters=(T.chinese_nouns(),))) == []


def test_chinese_filters(spark):
    assert run(spark, "今天，天气[好]\r\n明天 见", lambda t: T.chinese_lines(K.chinese_segments(t))) == ["今天", "天气", "好", "明天", "见"]
    assert run(spark, "我们，天气", Analyzer("zh")) == ["天气"] and "我们" in words("cn")
    cut = T.chinese_pauses(["中", "上"])
    assert run(spark, "天上地中人中", lambda t: cut(F.array(t))) == ["天上地", "人中"]
    assert run(spark, "中", lambda t: cut(F.array(t))) == ["", ""] and run(spark, "x", lambda t: cut(F.array(t))) == ["x"]
    tagger = DictionaryTagger({"中央": "n", "气象台": "n", "说": "v", "张三": "nr"})
    assert run(spark, "中央气象台说张三", lambda t: T.chinese_nouns(tagger, names=["张三"])(F.array(t))) == ["中央气象台", "张三", "张三"]


def test_segmentor_replaces_tokenizer(spark):
    a = Analyzer("zh", segmentor=lambda t: F.split(t, "/"), filters=(T.lowercase,))
    assert run(spark, "A/B", a) == ["a", "b"]


def test_dictionaries(spark, tmp_path):
    assert len(words("en")) == 923 and len(words("cn")) == 1472 and len(words("pause")) == 746
    assert words("pause")[:11] == ("$", *"0123456789")
    (tmp_path / "en_words.txt").write_text("// 2\nthe\na\n\n")
    assert sorted(map(tuple, read_dictionary(spark, f"{tmp_path}/*.txt").collect())) == [("en", "a"), ("en", "the")]
    assert dictionary(spark, ("en",)).count() == 923


def test_stem_postings(spark):
    post = spark.createDataFrame([("t", "cat", 1, 2), ("t", "cats", 1, 3), ("t", "cats", 2, 1)], "field string, token string, doc_id long, tf int")
    assert sorted(map(tuple, T.stem_postings(post).collect())) == [("t", "cat", 1, 5), ("t", "cat", 2, 1)]


def test_words_that_repeat_are_tagged_once(spark, tmp_path):
    """The tagger by words is asked once for each different word of a batch, and gives the same as for whole sequences."""
    from skriva.functions.tagging import tag_english

    texts = [(i, t) for i, t in enumerate(["Dogs Run quickly", None, "", "12 Dogs . ran", "dogs Berlin dogs Berlin", "Berlin", "the", "fish the fish dogs"] * 40)]
    docs = spark.createDataFrame(texts, "i int, t string").coalesce(1)
    tokens = lambda t: (t or "").split()
    split = F.when(F.length("t") > 0, F.split("t", " ")).otherwise(F.when(F.col("t") == "", F.array().cast("array<string>")))
    got = {r.i: r.x for r in docs.select("i", T.nouns()(split).alias("x")).collect()}
    whole = {r.i: r.x for r in docs.select("i", T.nouns(lambda x: tag_english(x))(split).alias("x")).collect()}
    assert got == whole == {i: [w for w, tag in zip(tokens(t), tag_english(tokens(t))) if tag in ("NN", "NNS")] for i, t in texts}
    log = tmp_path / "asked"

    class Told(type(tag_english)):
        @staticmethod
        def word(token, first):
            with open(log, "a") as f:
                f.write(f"{token} {first}\n")
            return "NN"

    assert docs.select(F.size(T.nouns(Told())(split)).alias("n")).agg(F.sum("n")).first()[0] == sum(len(tokens(t)) for _, t in texts)
    asked = [x for x in log.read_text().splitlines() if x.endswith("False")]
    assert len(asked) == len(set(asked)) == len({w for _, t in texts for w in tokens(t)})


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab Z9.-:\n中é²́", max_size=30))
def test_stripped_tokens_are_those_without_their_separator(spark, text):
    bare = lambda t: F.filter(F.transform(K.english(t), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+", "")), lambda x: x != "")
    assert run(spark, text, lambda t: K.english(t, True)) == run(spark, text, bare)
