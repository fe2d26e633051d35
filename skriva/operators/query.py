"""Boolean queries over postings, and BM25.

All query forms share one aggregation: the postings of the query's tokens (a pushed filter) grouped by document, into
one count per query token. Groups of tokens (all k-subsets and so on) then are tests on that row,
so their number multiplies neither the scan nor the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at_least_k_subsets, k_subsets

#: C(n, k) groups: with more distinct tokens than this, `k_groups` refuses; `matching`, and `bm25` with `least`, take any number, as one group.
MAX_TOKENS = 12
#: The width of the stretches of scores by which medians are found; with six digits one has 10,000 scores at most.
BIN = 0.01


def distinct_tokens(tokens: Sequence[str]) -> list[str]:
    return sorted(set(tokens))


def absolute_k(n: int, rate: float) -> int:
    """How many of n tokens a rate means: rounded down, one at least."""
    return max(1, min(n, int(n * rate + 1e-9)))


def k_groups(tokens: Sequence[str], k: float, at_least: bool) -> list[tuple[str, ...]]:
    """The subsets of k (a rate) of the tokens, or of that many and more."""
    own = distinct_tokens(tokens)
    if not own:
        return []
    if len(own) > MAX_TOKENS:
        raise ValueError(f"{len(own)} distinct tokens; at most {MAX_TOKENS} can be grouped")
    size = absolute_k(len(own), k)
    return at_least_k_subsets(own, size) if at_least else k_subsets(own, size)


def matches(postings: DataFrame, tokens: Sequence[str], field: str | None = None) -> DataFrame:
    """(doc_id, tf): an array of the counts of the distinct tokens, in their order, of each document with any of them; also field_len, if the postings have it."""
    own = distinct_tokens(tokens)
    rows = postings.filter(F.col("token").isin(own)) if own else postings.filter(F.lit(False))
    if field is not None:
        rows = rows.filter(F.col("field") == field)
    length = ["field_len"] if "field_len" in postings.columns else []
    if not own:
        return rows.select("doc_id", F.array().cast("array<int>").alias("tf"), *length)
    counts = [F.coalesce(F.sum(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).cast("int").alias(f"__{i}") for i, t in enumerate(own)]
    return rows.groupBy("doc_id").agg(*counts, *[F.max(c).alias(c) for c in length]).select("doc_id", F.array(*[f"__{i}" for i in range(len(own))]).alias("tf"), *length)


def matching(postings: DataFrame, tokens: Sequence[str], least: int, field: str | None = None) -> DataFrame:
    """(doc_id, matched) of the documents with at least that many distinct tokens: the documents of AND over subsets of that size."""
    found = matches(postings, tokens, field).select("doc_id", F.size(F.filter("tf", lambda n: n > 0)).alias("matched"))
    return found.filter(F.col("matched") >= least)


def _label(group: Sequence[str], every: bool) -> str:
    return ("&" if every else "|").join(group)


def grouped(found: DataFrame, tokens: Sequence[str], groups: Sequence[tuple[str, ...]], every: bool) -> DataFrame:
    """found (of `matches`) with a row for each group that a document meets: column `token_group`, and `slots`, the group's places in tf."""
    own = {t: i for i, t in enumerate(distinct_tokens(tokens))}
    if not groups:
        return found.filter(F.lit(False)).select("*", F.lit("").alias("token_group"), F.array().cast("array<int>").alias("slots"))
    table = F.array(*[F.struct(F.lit(_label(g, every)).alias("token_group"), F.array(*[F.lit(own[t]) for t in g]).alias("slots")) for g in groups])
    test = F.forall if every else F.exists
    met = F.filter(table, lambda g: test(g["slots"], lambda i: F.get(F.col("tf"), i) > 0))
    return found.select("*", F.explode(met).alias("__g")).select("*", "__g.token_group", "__g.slots").drop("__g")


def boolean_query(postings: DataFrame, tokens: Sequence[str], groups: Sequence[tuple[str, ...]], every: bool, field: str | None = None) -> DataFrame:
    """(token_group, doc_id)."""
    return grouped(matches(postings, tokens, field), tokens, groups, every).select("token_group", "doc_id")


def query_or(postings: DataFrame, tokens: Sequence[str], field: str | None = None) -> DataFrame:
    return boolean_query(postings, tokens, [tuple(distinct_tokens(tokens))] if tokens else [], False, field)


def query_and(postings: DataFrame, tokens: Sequence[str], field: str | None = None) -> DataFrame:
    return boolean_query(postings, tokens, [tuple(distinct_tokens(tokens))] if tokens else [], True, field)


def query_and_k(postings: DataFrame, tokens: Sequence[str], k: float, at_least: bool = False, field: str | None = None) -> DataFrame:
    """For every subset of k of the tokens (or of k and more) the documents with all of its tokens."""
    return boolean_query(postings, tokens, k_groups(tokens, k, at_least), True, field)


def query_or_k(postings: DataFrame, tokens: Sequence[str], k: float, at_least: bool = False, field: str | None = None) -> DataFrame:
    """For every subset of k of the tokens (or of k and more) the documents with any of its tokens."""
    return boolean_query(postings, tokens, k_groups(tokens, k, at_least), False, field)


def bm25(
    postings: DataFrame,
    stats: DataFrame | None,
    tokens: Sequence[str],
    groups: Sequence[tuple[str, ...]] | None = None,
    every: bool = False,
    k1: float = 1.0,
    b: float = 0.5,
    k2: float | None = None,
    n_scope: str = "candidates",
    idf: str = "classic",
    field: str | None = None,
    digits: int = 6,
    corpus: DataFrame | None = None,
    least: int | None = None,
) -> DataFrame:
    """(token_group, doc_id, score) by Okapi BM25.

    Lengths are those of the postings, where they have field_len, and else of stats (doc_id, field_len). With n_scope "corpus", corpus is one row
    (n, avg_len), or else comes of stats. With `least` the documents that have so many of the tokens are one group.

    N and the mean length are those of the candidates (documents with any token) or of the corpus; idf is
    ln((N - df + 0.5) / (df + 0.5)), which is negative for frequent tokens, or with "plus1" ln(1 + that).
    With k2, a token that the query repeats counts qtf (k2 + 1) / (qtf + k2) times.
    """
    own = distinct_tokens(tokens)
    groups = [tuple(own)] if groups is None and own else groups or []
    if not own:
        least = None
    lengths = stats if field is None or stats is None else stats.filter(F.col("field") == field)
    found = matches(postings, tokens, field)
    if "field_len" not in found.columns:
        found = found.join(lengths.select("doc_id", "field_len"), "doc_id")
    sums = [F.count("*").alias("n"), F.avg("field_len").alias("avg_len")]
    df = F.array(*[F.sum((F.get(F.col("tf"), F.lit(i)) > 0).cast("long")) for i in range(len(own))]) if own else F.array().cast("array<long>")
    if n_scope == "candidates":
        scope = found.agg(*sums, df.alias("df"))
    elif n_scope == "corpus":
        scope = (corpus if corpus is not None else lengths.agg(*sums)).crossJoin(found.agg(df.alias("df")))  # one row each
    else:
        raise ValueError(f"no such scope: {n_scope}")
    if least is not None:
        some = found.filter(F.size(F.filter("tf", lambda n: n > 0)) >= least)
        met = some.select("*", F.lit(f"{least} of {_label(own, every)}").alias("token_group"), F.array(*[F.lit(i) for i in range(len(own))]).alias("slots"))
    else:
        met = grouped(found, tokens, groups, every)
    rows = met.crossJoin(F.broadcast(scope))  # scope is one row

    def weight(i: Column) -> Column:
        tf, d = F.get(F.col("tf"), i).cast("double"), F.get(F.col("df"), i).cast("double")
        ratio = (F.col("n") - d + 0.5) / (d + 0.5)
        saturation = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("field_len") / F.col("avg_len"))
        query = F.lit(1.0)
        if k2 is not None:
            qtf = F.get(F.array(*[F.lit(float(list(tokens).count(t))) for t in own]), i)
            query = qtf * (k2 + 1.0) / (qtf + k2)
        return F.when(tf > 0, F.log(1 + ratio if idf == "plus1" else ratio) * tf * (k1 + 1.0) / (tf + saturation) * query).otherwise(F.lit(0.0))

    score = F.aggregate(F.col("slots"), F.lit(0.0), lambda acc, i: acc + weight(i))
    return rows.select("token_group", "doc_id", F.round(score, digits).alias("score"))


def group_scores(ranked: DataFrame) -> DataFrame:
    """(token_group, docs, group_score): the score in the middle of the group's list by falling score, for an even number the lower one.

    That is the discrete median. It is found in two steps, so that no task holds a group's list or all of its different scores: the counts
    of stretches of BIN tell which stretch it is in, and the counts of the scores in that stretch tell the score.
    """
    order = Window.partitionBy("token_group").orderBy("bin")
    counts = ranked.groupBy("token_group", "score").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") / BIN))
    bins = counts.groupBy("token_group", "bin").agg(F.sum("n").alias("n"))
    summed = bins.select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("token_group")).alias("docs"))
    place = F.floor((F.col("docs") + 1) / 2)
    inside = summed.filter((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)).select("token_group", "bin", "docs", (place - F.col("upto") + F.col("n")).alias("place"))
    scores = counts.join(F.broadcast(inside), ["token_group", "bin"])  # one row a group, at most 2^MAX_TOKENS
    counted = scores.withColumn("upto", F.sum("n").over(Window.partitionBy("token_group").orderBy("score")))
    return counted.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select("token_group", "docs", F.col("score").alias("group_score"))


def ranked_groups(ranked: DataFrame) -> DataFrame:
    """(token_group, group_score, doc_id, score), best group first, then best document: a distributed sort, nothing is cut off."""
    scores = group_scores(ranked).select("token_group", "group_score")
    groups = F.broadcast(scores)  # one row a token group, at most 2^MAX_TOKENS
    return ranked.join(groups, "token_group").select("token_group", "group_score", "doc_id", "score").orderBy(F.desc("group_score"), "token_group", F.desc("score"), "doc_id")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The k best documents of each group, with their rank; each task cuts its own rows first."""
    order = Window.partitionBy("token_group").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
