"""Language identification by compression.

For each language a raw-content zstd dictionary of DICT_BYTES is cut from labelled documents. A text is
normalised (lower case, one space for every run without letters), cut into pieces of PIECE bytes that together are the whole text, and each piece is
compressed with every dictionary; the language with the smallest sum is chosen. Pieces keep long texts from
compressing by their own past, which would hide the dictionary. If the runner-up is nearer than MARGIN of
its size, the text is rejected.

Training reads whole texts of at most MAX_SAMPLE labelled documents of a language, chosen by a hash of their id. A dictionary has the same number of
bytes of each of them, where texts are long enough, so that none fills it: short texts are in it whole, and of a longer one as many
words, evenly spread over all of it in runs of RUN bytes, as make its share. Every language that a row names has a dictionary.

Defined results: null texts and texts without letters have no language, no sizes and aren't accepted; a null doc_id passes
through; repeated rows give repeated results; an empty table gives an empty result; with fewer than two
languages in the training table everything is rejected, as there is no runner-up; a tie is a margin of 0 and so rejected; a text of any length is
classified whole; further columns, also of names that differ by case only, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at, cut, load, placed

DICT_BYTES, MAX_SAMPLE, RUN, MAX_BROADCAST = 32 << 10, 64, 256, 100_000
PIECE, LEVEL, MARGIN = 1024, 6, 0.02
_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode()


class Classifier:
    """Dictionaries by language."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN):
        self.languages, self.margin = sorted(dictionaries), margin
        self.raw = [dictionaries[k] for k in self.languages]
        self._packers: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_packers": None}

    def sizes(self, data: bytes) -> list[int]:
        if self._packers is None:
            self._packers = []
            for raw in self.raw:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum([len(p.compress(x)) for x in pieces]) for p in self._packers]

    def classify(self, text: str | None) -> tuple[str | None, float | None, int | None, bool]:
        """(nearest language, margin to the runner-up, compressed size, accepted)."""
        data = normalise(text) if text else b""
        if not data or not self.languages:
            return None, None, None, False
        sizes = self.sizes(data)
        ranked = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best, after = sizes[ranked[0]], sizes[ranked[1]] if len(ranked) > 1 else sizes[ranked[0]]
        margin = (after - best) / after
        return self.languages[ranked[0]], round(margin, 6), best, margin >= self.margin


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE) -> Classifier:
    """A classifier from a bounded sample of the rows with a language."""
    known = placed(docs).select(F.col(at(docs, id_col)).alias("i"), F.col(at(docs, lang_col)).alias("l"), F.col(at(docs, text_col)).alias("t")).filter("i IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL")
    hashed = known.withColumn("h", F.xxhash64("i"))
    # the ids first, without texts; each task cuts its own rows before they are shuffled by language
    of_lang = Window.partitionBy("l")
    ids = cut(hashed.select("l", "h", "i").withColumn("n", F.row_number().over(of_lang.orderBy("h", "i"))).filter(F.col("n") <= max_sample).select("l", "i").distinct())
    few = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids  # max_sample ids a language
    drawn = hashed.join(few, ["l", "i"]).withColumn("n", F.row_number().over(of_lang.orderBy("h", "i", "t")))
    rows = drawn.filter(F.col("n") <= max_sample).select("l", "n", "t").orderBy("l", "n").toLocalIterator()  # a language at a time
    return Classifier({lang: dictionary([r.t for r in own]) for lang, own in groupby(rows, key=lambda r: r.l)})


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """At most size bytes of the normalised texts, as many of each of them as of the others, or all of it where it has fewer."""
    data = [x for t in texts if (x := normalise(t))]
    left, out = size, [b""] * len(data)
    for done, k in enumerate(sorted(range(len(data)), key=lambda k: len(data[k]))):  # short ones leave their rest to the others
        share = max(0, left // (len(data) - done) - 1)
        out[k] = spread(data[k], share)
        left -= len(out[k]) + 1
    return b" ".join(x for x in out if x)


def spread(data: bytes, size: int, run: int = RUN) -> bytes:
    """At most size bytes of data, in runs that begin at evenly spaced places; all of it where it fits."""
    if len(data) <= size:
        return data
    runs = max(1, size // run)
    n, last = size // runs, len(data) - size // runs
    return b"".join(data[a : a + n] for a in (last * k // max(1, runs - 1) for k in range(runs)))


SCHEMA = "predicted string, margin double, compressed_bytes long, accepted boolean"


def classifier_udf(model: Classifier):
    kind = pa.struct([("predicted", pa.string()), ("margin", pa.float64()), ("compressed_bytes", pa.int64()), ("accepted", pa.bool_())])

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = list(zip(*[model.classify(t.as_py()) for t in texts])) or [(), (), (), ()]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, kind)], fields=list(kind))

    return classify


def identify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, margin, compressed_bytes, accepted) of every row; lang is null where it is rejected, predicted is the nearest in any case."""
    rows = placed(docs).select(F.col(at(docs, id_col)).alias("doc_id"), classifier_udf(model)(F.col(at(docs, text_col))).alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", F.when(F.col("accepted"), F.col("predicted")).alias("lang"), "predicted", "margin", "compressed_bytes", "accepted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
