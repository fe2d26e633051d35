"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding maps every character to one character (accents, homoglyphs, full-width and mathematical letters,
digit and symbol substitutions), so that positions in the folded text are positions in the text and word
boundaries can be checked against the characters actually written. Zero-width and combining characters are
removed first. `l`, `1`, `!` and `|` share one class with `i`, in the lexicon as in the text.

score = 1000 * (sum of the weights of the matches) / (words + SMOOTH); a document is toxic if its score is
THRESHOLD or more and the sum of weights EVIDENCE or more. Of matches that begin together the heaviest counts, and a match inside an
exception phrase ("trash can") doesn't.

The lexicon is a published list of plain insults, plus terms learned from labelled documents: words, and beginnings
of words (written "abc*"), whose distinct contexts (the word before and the word after) are concentrated in toxic documents. Counting contexts
instead of documents keeps copies of one toxic document from making all its rare words toxic. At most
MAX_TOXIC toxic and MAX_CLEAN clean labelled documents are read for this, chosen by a hash of their id; every term that passes
the thresholds is kept, however many they are.

Words of SPELT letters or more are also found with their letters set apart ("i d i o t", also by . - _ or *) and with "rn" in place of "m".
Words that are insults only of people ("trash", "vermin") have less weight alone than the phrases that say so.

Defined results: a null or empty text has no words, no hits, score 0 and isn't toxic; a null doc_id passes
through; repeated rows give repeated results; an empty table gives an empty result; further columns, whatever
their names (also those that differ by case only), are ignored by `score_documents` and kept untouched by `drop_toxic`; texts of any length are read whole. A document whose
labels differ counts as toxic. Without labels (an empty table, or labels that are all null or all of one class) only the published list is used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, cut, exact, hash_order, load, placed, restored

MAX_TOXIC, MAX_CLEAN = 4000, 12000
MIN_CONTEXTS, MIN_LOG_ODDS, MIN_WORDS = 5, 3.0, 5
SPELT, APART = 4, " .-_*"
BEGINNINGS = (4, 5, 6, 7, 8)
SMOOTH, THRESHOLD, EVIDENCE = 50, 5.0, 0.9

LEXICON = {w: 1.0 for w in (
    "idiot idiots moron morons stupid loser losers scumbag pathetic worthless disgusting imbecile "
    "dumbass jackass asshole bastard bitch retard scumbags imbeciles subhuman degenerate shithead dickhead fuckwit "
    "idioten arschloch dummkopf abschaum idiote connard salaud imbécile idiota imbécil estúpido basura"
).split()} | {"crap": 0.5, "dumb": 0.6, "garbage": 0.5, "ugly": 0.4, "shut up": 0.6, "piece of garbage": 1.5, "waste of space": 1.5} | {
    w: 0.6 for w in ("scum", "clown", "clowns", "trash", "vermin")} | {
    f"{a} {b}": 1.0 for a in ("you", "you are", "you're", "they are", "such", "human", "absolute", "piece of", "bunch of") for b in ("scum", "trash", "garbage", "vermin", "clown", "clowns")}
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "garbage collection", "garbage collector", "garbage can", "garbage truck",
    "class clown", "clown fish", "circus clown", "rodeo clown", "pond scum", "soap scum", "sore loser", "winner and loser", "winners and losers",
    "rendered worthless", "worthless check", "ugly duckling", "idiot proof", "useful idiot", "dumb waiter", "dumb terminal",
)

_GONE = re.compile("[­̀-ͯ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_LEET = dict(zip("0134578@$!|+€£9l", "oieastbasiiteigi"))
_LOOKS = dict(zip(
    "абвгдеёзіїјкмнорстухћһԁԛԝѕьγαβεηικνορτυχωðđøłıſ",
    "a6brdeesiijkmhopctyxhhdqwsbyabenikvoptuxwddoiis",
))
_LOOKS["в"] = "b"


def _table() -> dict[int, str]:
    table: dict[int, str] = {}
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1F130, 0x1F18A)):
        for c in range(lo, hi):
            base = [x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x) and x.isalnum()]
            if len(base) == 1 and base[0].isascii():
                table[c] = base[0]
    table |= {ord(k): v for k, v in _LOOKS.items()}
    table |= {ord(k.upper()): v for k, v in _LOOKS.items() if len(k.upper()) == 1}
    table = {k: _LEET.get(v, v) for k, v in table.items()}
    return table | {ord(k): v for k, v in _LEET.items()}


_TABLE = _table()
_ASCII = str.maketrans(_LEET | {chr(c): _LEET.get(chr(c).lower(), chr(c).lower()) for c in range(65, 91)})
_ASCII = {k: v for k, v in _ASCII.items() if k < 128}


def fold(text: str) -> tuple[str, str]:
    """(the text without invisible characters, the folded text of the same length)."""
    if text.isascii():
        return text, text.translate(_ASCII)
    text = _GONE.sub("", text)
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return text, low.translate(_TABLE)


def variants(key: str) -> list[str]:
    """Other spellings of a folded word."""
    if len(key) < SPELT or not key.isalpha():
        return []
    return [sep.join(key) for sep in fold(APART)[1]] + [key.replace("m", "rn")] * ("m" in key)


class Matcher:
    """The automaton of a lexicon {term: weight}; phrases in exceptions cancel the matches inside them."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.machine = ahocorasick.Automaton()
        terms: dict[str, list[float]] = {}  # weight as a word, as a beginning; exceptions have none
        for term, weight in lexicon.items():
            if key := fold(term.rstrip("*"))[1].strip():
                pair = terms.setdefault(key, [0.0, 0.0])
                pair[term[-1] == "*"] = max(weight, pair[term[-1] == "*"])
        for key, (whole, _) in list(terms.items()):
            for x in variants(key) if whole else ():
                pair = terms.setdefault(x, [0.0, 0.0])
                pair[0] = max(whole, pair[0])
        terms |= {fold(x)[1]: [] for x in exceptions}
        for key, weights in terms.items():
            self.machine.add_word(key, (len(key), weights))
        if terms:
            self.machine.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each match in the text without its invisible characters."""
        if not len(self.machine):
            return []
        raw, folded = fold(text)
        best: dict[int, tuple[float, int]] = {}
        excused, n = [], len(raw)
        for last, (length, weights) in self.machine.iter(folded):
            start, end = last - length + 1, last + 1
            if start and raw[start - 1].isalnum():
                continue
            whole = end == n or not raw[end].isalnum()
            if not weights:
                if whole:
                    excused.append((start, end))
            elif weight := max(weights[0] if whole else 0.0, weights[1]):
                best[start] = max(best.get(start, (0.0, 0)), (weight, end))
        return [(s, e, w) for s, (w, e) in sorted(best.items()) if not any(a <= s and e <= b for a, b in excused)]

    def score(self, text: str | None) -> tuple[int, int, float, bool]:
        """(words, hits, score, toxic)."""
        if not text:
            return 0, 0, 0.0, False
        found, words = self.matches(text), len(text.split())
        weight = sum(w for *_, w in found)
        score = round(1000.0 * weight / (words + SMOOTH), 6)
        return words, len(found), score, score >= THRESHOLD and weight >= EVIDENCE


def contexts(text: str | None) -> list[str]:
    """Folded words of three letters or more with their neighbours, each once, as "word|context"."""
    words = [w for x in fold(text or "")[1].split() if (w := x.strip(".,;:!?\"'()[]{}*%&#-_=+/<>"))]
    out = {f"{w}|{hash_pair(a, b)}" for a, w, b in zip(["", *words], words, [*words[1:], ""]) if len(w) > 2 and "|" not in w}
    return sorted(out)


def hash_pair(a: str, b: str) -> str:
    import xxhash

    return xxhash.xxh32_hexdigest(f"{a} {b}")


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Terms with weights from at most MAX_TOXIC + MAX_CLEAN labelled documents."""
    known = exact(labels, id_col, "toxic").toDF("i", "y").dropna().groupBy("i").agg(F.max("y").alias("y"))
    order = hash_order(F.col("i"))
    sample = known.filter("y = 1").orderBy(*order).limit(MAX_TOXIC).union(known.filter("y = 0").orderBy(*order).limit(MAX_CLEAN))

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([contexts(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    pairs = exact(docs, id_col, text_col).toDF("i", "t").join(F.broadcast(sample), "i").select("y", F.explode(words("t")).alias("w"))  # the sample's size is bounded
    seen = pairs.groupBy("w").agg(F.max("y").alias("y"), F.min("y").alias("z")).select(F.substring_index("w", "|", 1).alias("word"), "y", "z")
    counts = cut(seen.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("z")).alias("b")))  # read three times
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total or not total.a or not total.b:
        return {}
    odds = math.log(total.b + 1) - math.log(total.a + 1)
    starts = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("p")) for n in BEGINNINGS])).alias("x"), "word", "a", "b").filter(F.length("word") > F.col("x.n"))
    starts = starts.groupBy(F.concat("x.p", F.lit("*")).alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum((F.col("a") > 0).cast("int")).alias("words")).filter(F.col("words") >= MIN_WORDS).drop("words")
    rows = (
        counts.union(starts)
        .filter(F.col("a") >= MIN_CONTEXTS)
        .withColumn("odds", F.log(F.col("a") + 0.5) - F.log(F.col("b") + 0.5) + F.lit(odds))
        .filter(F.col("odds") >= MIN_LOG_ODDS)
        .collect()  # of the terms of a bounded sample
    )
    return {r.word: round(r.a / (r.a + 4.0) * min(1.0, (r.odds - 2) / 3), 4) for r in rows}


def fit(docs: DataFrame, labels: DataFrame | None, **cols: str) -> Matcher:
    learned = learn_lexicon(docs, labels, **cols) if labels is not None else {}
    return Matcher({k: max(LEXICON.get(k, 0.0), learned.get(k, 0.0)) for k in LEXICON | learned})


SCHEMA = "n_words int, hits int, score double, toxic boolean"


def scorer(matcher: Matcher):
    """An Arrow UDF: text -> struct(n_words, hits, score, toxic)."""
    kind = pa.struct([("n_words", pa.int32()), ("hits", pa.int32()), ("score", pa.float64()), ("toxic", pa.bool_())])

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [matcher.score(t.as_py()) for t in texts]
            yield pa.array([{"n_words": n, "hits": h, "score": s, "toxic": y} for n, h, s, y in rows], kind)

    return score


def score_documents(docs: DataFrame, matcher: Matcher, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, score, toxic) of every row."""
    return placed(docs).select(F.col(at(docs, id_col)).alias("doc_id"), scorer(matcher)(F.col(at(docs, text_col))).alias("r")).select("doc_id", "r.*")


def drop_toxic(docs: DataFrame, matcher: Matcher, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic, with all columns."""
    return restored(placed(docs).filter(~scorer(matcher)(F.col(at(docs, text_col)))["toxic"]), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
