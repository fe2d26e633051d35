"""Token filters: functions from a token array to a token array (Columns), to be chained in any order.

Those that need Python are Arrow UDFs. On a corpus, prefer `stem_postings`, which stems each distinct token once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem, stem_udf
from ..functions.tagging import ChineseTagger, EnglishTagger, WordTagger, noun_runs, tag_chinese, tag_english
from .dictionary_data import words

TokenFilter = Callable[[Column], Column]
#: Characters at which Chinese text is cut into lines; the space is one, line ends aren't.
LINE_MARKS = " $%*-/<=>?[\\]" + "‘’《》【】。！，；？（）"
_LINE = "[" + "".join("\\" + c if ord(c) < 128 else c for c in LINE_MARKS) + "]"


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def stop_words(stop: Iterable[str] | None = None) -> TokenFilter:
    """Drops the listed tokens (the English list by default). The list becomes a literal hash set of the plan (InSet)."""
    drop = list(words("en") if stop is None else stop)
    return (lambda tokens: F.filter(tokens, lambda t: ~t.isin(drop))) if drop else (lambda tokens: tokens)


def min_length(n: int) -> TokenFilter:
    return lambda tokens: F.filter(tokens, lambda t: F.length(t) >= n)


def _same_lists(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of the same sizes as `lists` with those values; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def stems(tokens: Column) -> Column:
    """Every token's stem, in place."""

    @F.arrow_udf("array<string>")
    def stem_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = lists.flatten().dictionary_encode()
            yield _same_lists(lists, pa.array([stem(x) for x in flat.dictionary.to_pylist()], pa.string()).take(flat.indices))

    return stem_all(tokens)


def nouns(tagger: EnglishTagger = tag_english) -> TokenFilter:
    """Keeps the tokens tagged NN or NNS. The tagger sees the whole sequence; one that tags each word by itself (WordTagger) sees each different word of a batch."""

    def by_word(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        words, at = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        noun = lambda first, some: np.array([tagger.word(w, first) in ("NN", "NNS") for w in some], bool)
        kept = noun(False, words)[at]
        heads = starts[sizes > 0]
        kept[heads] = noun(True, [words[k] for k in at[heads]])
        ends = np.concatenate([[0], np.cumsum(kept)])[np.append(starts, len(at))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat.dictionary.cast(pa.string()).take(pa.array(at[kept])))

    @F.arrow_udf("array<string>")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            if isinstance(tagger, WordTagger):
                yield by_word(lists)
            else:
                yield pa.array([[t for t, tag in zip(x, tagger(x)) if tag in ("NN", "NNS")] for x in (y or [] for y in lists.to_pylist())], pa.list_(pa.string()))

    return keep


def chinese_lines(tokens: Column) -> Column:
    """Cuts tokens at LINE_MARKS, without empty pieces."""
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, _LINE, -1))), lambda t: t != "")


def chinese_stop_words(tokens: Column) -> Column:
    """Drops a segment that as a whole is a stop word."""
    return stop_words(words("cn"))(tokens)


def chinese_pauses(pauses: Iterable[str] | None = None) -> TokenFilter:
    """Cuts a token once, at the first place of the first listed pause word that it holds; both sides stay, even if empty."""
    listed = list(words("pause") if pauses is None else pauses)

    def cut(token: Column) -> Column:
        held = F.filter(F.array(*[F.lit(p) for p in listed]), lambda p: F.instr(token, p) > 0)
        first = F.get(held, F.lit(0))
        at = F.instr(token, first)
        return F.when(first.isNull(), F.array(token)).otherwise(F.array(F.substring(token, F.lit(1), at - 1), F.substring(token, at + F.length(first), F.length(token))))

    return (lambda tokens: F.flatten(F.transform(tokens, cut))) if listed else (lambda tokens: tokens)


def chinese_nouns(tagger: ChineseTagger = tag_chinese, names: Iterable[str] = (), drop_last: bool = False) -> TokenFilter:
    """Runs of nouns of each segment, joined, and then its words that are in `names`."""
    known = frozenset(names)

    @F.arrow_udf("array<string>")
    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for segments in lists.to_pylist():
                found: list[str] = []
                for s in segments or []:
                    tagged = tagger(s)
                    found += noun_runs(tagged, drop_last) + [w for w, _ in tagged if w in known]
                out.append(found)
            yield pa.array(out, pa.list_(pa.string()))

    return merge


def chain(tokens: Column, *filters: TokenFilter) -> Column:
    for f in filters:
        tokens = f(tokens)
    return tokens


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings whose tokens are stemmed: the UDF sees each distinct token of a field once, then counts are added up."""
    vocabulary = postings.select("token").distinct().withColumn("stem", stem_udf()("token"))
    joined = postings.join(vocabulary, "token").select("field", F.col("stem").alias("token"), "doc_id", "tf")
    return joined.groupBy("field", "token", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))
