"""Named queries: each takes (spark, folder of tables) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..functions import scalar
from ..operators import dictionary as D
from ..operators import filters as T
from ..operators import index as I
from ..operators import query as Q
from ..operators import tokenize as K
from ..operators.dictionary_data import dictionary
from ..session import shared_path
from ..sources import loaders, store
from ..streaming.build import document_stream, read_index, stream_build
from .sql import CHINESE, LONG_TOKENS, QUERY_TOKENS, SHORT_TOKENS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def named(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return loaders.read_table(spark, folder, name)


def _tokens(docs: DataFrame, tokens) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tokens).alias("pos", "token"))


def _counts(docs: DataFrame, tokens) -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return I.postings(_table(spark, folder))


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, folder)
    return I.postings(docs), I.doc_stats(docs)


# tokenizers and filters


@named
def tokenize_en(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(_table(spark, folder), K.english(F.col("text")))


@named
def tokenize_en_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(_table(spark, folder), K.english(F.col("text"), strip_separator=True))


@named
def tokenize_en_pos(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder).select("doc_id", F.explode(K.english_positions(F.col("text"))).alias("t")).select("doc_id", "t.*")


@named
def lowercase_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_table(spark, folder), T.lowercase(K.english(F.col("text"))))


@named
def stopword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_table(spark, folder), I.Analyzer(filters=(T.lowercase, T.stop_words()))(F.col("text")))


@named
def stem_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return T.stem_postings(I.postings(_table(spark, folder), analyzer=I.Analyzer(filters=(T.lowercase,), strip_separator=True)))


@named
def index_nlp_nouns(spark: SparkSession, folder: str) -> DataFrame:
    return I.postings(_table(spark, folder), analyzer=I.Analyzer(filters=(T.lowercase, T.nouns(), T.stop_words(), T.stems), strip_separator=True))


@named
def zh_line_split(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(_table(spark, folder), T.chinese_lines(K.chinese_segments(F.col("text"))))


@named
def zh_stop_words(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_table(spark, folder), I.Analyzer("zh")(F.col("text")))


@named
def zh_pause_split(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(_table(spark, folder, "part").withColumnRenamed("p_partkey", "doc_id"), T.chinese_pauses()(K.chinese_segments(F.col("p_name"))))


@named
def zh_nouns(spark: SparkSession, folder: str) -> DataFrame:
    """Nouns of Chinese sentences about the parts, whose names are translated, as the tables have no Chinese; rings count as names too."""
    words = F.split("p_name", " ")
    to = F.create_map(*[F.lit(x) for pair in CHINESE.items() for x in pair])
    text = F.concat(F.lit("我们在"), to[words[1]], F.lit("工厂看到了"), to[words[0]], F.lit("的"), to[words[1]], F.lit("，非常好"))
    return _counts(_table(spark, folder, "part"), I.Analyzer("zh", filters=(T.chinese_nouns(names=(CHINESE["ring"],)),))(text))


@named
def dictionary_words(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary(spark).groupBy("name").agg(F.count("*").alias("words"))


# index


@named
def build_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder)


@named
def build_postings_binary(spark: SparkSession, folder: str) -> DataFrame:
    return I.postings(_table(spark, folder), binary_tf=True)


@named
def posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = I.posting_lists(_postings(spark, folder))
    return lists.select("token", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"), F.array_join(F.transform("tfs", lambda x: x.cast("string")), ",").alias("tfs"))


@named
def tf_map(spark: SparkSession, folder: str) -> DataFrame:
    """The posting map of each token, asked for the smallest document of the corpus."""
    first = _table(spark, folder).agg(F.min("doc_id").alias("first"))
    return I.posting_map(_postings(spark, folder)).crossJoin(F.broadcast(first)).select("token", F.size("docs").alias("df"), F.coalesce(F.try_element_at("docs", F.col("first")), F.lit(0)).alias("tf_in_first"))


@named
def tf_of_token(spark: SparkSession, folder: str) -> DataFrame:
    return I.term_frequency(_postings(spark, folder), QUERY_TOKENS[0], _table(spark, folder))


@named
def doc_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder)
    return I.doc_stats(docs).withColumnRenamed("field_len", "chars").join(I.doc_stats(docs, unit="bytes").withColumnRenamed("field_len", "bytes"), ["field", "doc_id"])


@named
def vocab_df(spark: SparkSession, folder: str) -> DataFrame:
    return I.vocabulary(_postings(spark, folder))


@named
def multi_field_build(spark: SparkSession, folder: str) -> DataFrame:
    part = _table(spark, folder, "part").withColumnRenamed("p_partkey", "doc_id")
    pages = _table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")
    names = I.multi_field(part, ["p_name", "p_brand"])
    return I.vocabulary(names.unionByName(I.multi_field(pages, ["url", "html"])))


@named
def merge_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and conversation turns, indexed apart and merged into one table by token."""
    talk = _table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return I.merge_postings(_postings(spark, folder), I.postings(talk))


@named
def incremental_build(spark: SparkSession, folder: str) -> DataFrame:
    """English documents first, then what the build log doesn't have."""
    docs = _table(spark, folder)
    first = docs.filter("lang = 'en'")
    log = first.select(F.lit("text").alias("field"), "doc_id", F.lit(1).cast("long").alias("batch_id"))
    return I.postings(first).unionByName(I.postings(I.unbuilt(docs, log, "text")))


@named
def compact_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Two generations of postings on disk, of doubled texts and then of the texts; compaction keeps the newer record."""
    path = shared_path(spark, "generations")
    docs = _table(spark, folder)
    store.write_postings(I.postings(docs.withColumn("text", F.concat_ws(" ", "text", "text"))), f"{path}/generation=0")
    store.write_postings(I.postings(docs), f"{path}/generation=1")
    store.compact(spark, path, f"{path}-compact", force=True)
    return store.read_postings(spark, f"{path}-compact")


@named
def stream_build_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Structured Streaming: micro-batches of document files into the index, then its vocabulary."""
    path = shared_path(spark, "stream")
    docs = _table(spark, folder)
    docs.repartition(4, "doc_id").write.parquet(f"{path}/in")
    stream_build(document_stream(spark, f"{path}/in", docs.schema, 2), f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return I.vocabulary(read_index(spark, f"{path}/index", "postings"))


# dictionary


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return I.vocabulary(_postings(spark, folder)).select("token", "df", "cf")


@named
def token_exact(spark: SparkSession, folder: str) -> DataFrame:
    return D.exact(_vocabulary(spark, folder), QUERY_TOKENS[0])


@named
def token_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return D.prefix(_vocabulary(spark, folder), "re")


@named
def token_range(spark: SparkSession, folder: str) -> DataFrame:
    return D.between(_vocabulary(spark, folder), "ma", "pe", upper=False)


@named
def dict_refcount(spark: SparkSession, folder: str) -> DataFrame:
    return D.term_records(_table(spark, folder).select(F.col("text").alias("suffix"), F.col("doc_id").alias("id")))


@named
def dict_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary's counts, added to those of the conversations, where both have the token."""
    talk = _table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    new = I.vocabulary(I.postings(talk)).select("token", "cf")
    return D.upsert_with(_vocabulary(spark, folder).select("token", "cf"), new, "cf", F.col("old") + F.col("new"))


@named
def dict_delete(spark: SparkSession, folder: str) -> DataFrame:
    stop = dictionary(spark, ("en",)).select(F.col("word").alias("token"))
    return D.delete(_vocabulary(spark, folder), stop)


@named
def bloom_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Which tokens are stop words, by a Bloom filter of two merged halves."""
    stop = dictionary(spark, ("en",))
    short = D.bloom_build(stop.filter("length(word) < 5"), "word")
    long = D.bloom_build(stop.filter("length(word) >= 5"), "word")
    return D.bloom_test(_vocabulary(spark, folder), "token", D.bloom_merge(short, long))


# boolean queries


@named
def query_or(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_or(_postings(spark, folder), QUERY_TOKENS)


@named
def query_and(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_and(_postings(spark, folder), SHORT_TOKENS)


@named
def query_and_k(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_and_k(_postings(spark, folder), QUERY_TOKENS, 0.5)


@named
def query_and_k_least(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_and_k(_postings(spark, folder), QUERY_TOKENS, 0.5, at_least=True)


@named
def query_or_k(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_or_k(_postings(spark, folder), QUERY_TOKENS, 0.5)


@named
def query_or_k_least(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_or_k(_postings(spark, folder), QUERY_TOKENS, 0.5, at_least=True)


@named
def query_matching(spark: SparkSession, folder: str) -> DataFrame:
    return Q.matching(_postings(spark, folder), QUERY_TOKENS, 2)


@named
def query_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Search in English documents that are labelled as good."""
    labels = _table(spark, folder, "labels").filter("quality = 1").select("doc_id").distinct()
    docs = _table(spark, folder).filter("lang = 'en'").select("doc_id")
    return Q.query_or(_postings(spark, folder), QUERY_TOKENS).join(docs, "doc_id", "left_semi").join(labels, "doc_id", "left_semi")


# ranking


@named
def bm25_or(spark: SparkSession, folder: str) -> DataFrame:
    return Q.bm25(*_index(spark, folder), QUERY_TOKENS)


@named
def bm25_and(spark: SparkSession, folder: str) -> DataFrame:
    return Q.bm25(*_index(spark, folder), SHORT_TOKENS, every=True)


@named
def bm25_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """N and mean length of the whole corpus, idf that is never negative, and a saturated query term frequency."""
    return Q.bm25(*_index(spark, folder), [*QUERY_TOKENS, QUERY_TOKENS[0]], n_scope="corpus", idf="plus1", k2=0.75)


@named
def bm25_group_median(spark: SparkSession, folder: str) -> DataFrame:
    groups = Q.k_groups(QUERY_TOKENS, 0.5, False)
    return Q.group_scores(Q.bm25(*_index(spark, folder), QUERY_TOKENS, groups, every=True))


@named
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return Q.top_k(Q.bm25(*_index(spark, folder), QUERY_TOKENS), 20)


def _engine(spark: SparkSession, folder: str, **options) -> SearchEngine:
    """All documents loaded and built in two steps."""
    engine = SearchEngine(spark, shared_path(spark, "engine"), **options)
    docs = _table(spark, folder)
    engine.load(docs.filter("lang = 'en'"), "english")
    engine.build("text")
    engine.load(docs.filter("lang IS NULL OR lang <> 'en'"), "other")
    engine.build("text")
    return engine


_TEXT = " ".join(QUERY_TOKENS)


@named
def engine_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Load, build in two steps, and query through the facade."""
    return _engine(spark, folder).query_or(_TEXT, "text").select("token_group", "doc_id", "score")


@named
def engine_query_or(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_or(_TEXT, "text")


@named
def engine_query_and(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_and(" ".join(SHORT_TOKENS), "text")


@named
def engine_query_and_k(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_and_k(_TEXT, "text", 0.5)


@named
def engine_query_and_k_least(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_and_k_least(_TEXT, "text", 0.5)


@named
def engine_query_or_k(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_or_k(_TEXT, "text", 0.5)


@named
def engine_query_or_k_least(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).query_or_k_least(_TEXT, "text", 0.5)


@named
def engine_corpus_scope(spark: SparkSession, folder: str) -> DataFrame:
    """N and mean length of the whole corpus, as the batches have summed them."""
    return _engine(spark, folder, n_scope="corpus", idf="plus1").query_or(_TEXT, "text").select("token_group", "doc_id", "score")


@named
def engine_many_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Half of more tokens than can be put in groups: the documents are one group."""
    return _engine(spark, folder).query_and_k_least(" ".join(LONG_TOKENS), "text", 0.5).select("token_group", "doc_id", "score")


def _replaced(spark: SparkSession, folder: str) -> SearchEngine:
    """Every document built with another text first, and the English ones loaded and built anew."""
    engine, docs = SearchEngine(spark, shared_path(spark, "engine")), _table(spark, folder)
    engine.load(docs.withColumn("text", F.concat(F.lit("obsolete words "), "text")))
    engine.build("text")
    engine.load(docs.filter("lang = 'en'"))
    engine.build("text")
    return engine


@named
def engine_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are loaded again are indexed anew, and their earlier postings count no more."""
    return _replaced(spark, folder).postings.select("token", "doc_id", "tf", "field_len")


@named
def engine_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The same once the index is rewritten without them."""
    engine = _replaced(spark, folder)
    engine.compact(force=True)
    return read_index(spark, engine.path, "postings").select("token", "doc_id", "tf", "field_len")


@named
def engine_doc_types(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).doc_types()


@named
def engine_ids_of_type(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).ids("english").select("doc_id")


@named
def engine_document_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder).document_fields().select("doc_id", F.array_join(F.array_sort("fields"), " ").alias("fields"))


# documents


@named
def doc_fetch_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return store.fetch(_table(spark, folder), [3, 5, 8, 13, 1000000]).select("doc_id", "text", "lang")


@named
def doc_fetch_found(spark: SparkSession, folder: str) -> DataFrame:
    return store.fetch_all(_table(spark, folder), Q.query_and(_postings(spark, folder), SHORT_TOKENS)).select("doc_id", "lang", "n_chars")


@named
def doc_types(spark: SparkSession, folder: str) -> DataFrame:
    docs = loaders.documents(_table(spark, folder).select("doc_id", "text"), "document")
    pages = loaders.documents(_table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "page")
    return store.sizes(docs.unionByName(pages), ["text"])


@named
def doc_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "pages").select("page_id", scalar.document_id("wiki", F.col("url")).alias("id"))


@named
def doc_dedupe_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under an id made of their text: the one stored last stays."""
    rows = _table(spark, folder).select(F.sha2("text", 256).alias("id"), F.col("doc_id").alias("stored"), "lang")
    return loaders.latest(rows, F.col("stored"), "id")


@named
def news_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as text files in category folders (a file for each turn), loaded, exported as XML, and read again."""
    path = shared_path(spark, "news")
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("Talk"), "conv_id", "turn"), F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), F.lit("End"))
    rows = _table(spark, folder, "conversations").select(F.concat(F.lit("by "), F.col("role")).alias("category"), text.alias("value"))
    loaders.write_news_texts(rows, f"{path}/texts")
    read = loaders.read_news_texts(spark, f"{path}/texts")
    news = read.withColumn("category", F.substring_index("category", "=", -1)).withColumn("content", F.rtrim("content", F.lit("\x01")))
    loaders.write_news_xml(news, f"{path}/xml")
    return loaders.read_news_xml(spark, f"{path}/xml", strict=True).select("category", "title", "content")


@named
def wiki_xml_gz(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with all of their text as a gzip XML dump with links, loaded again."""
    path = shared_path(spark, "wiki")
    words = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[^\p{L}\p{N}]+", " "))
    pages = _table(spark, folder, "pages").select(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url", words.alias("abstract"), F.struct(F.array(F.struct(F.lit("nav").alias("_linktype"), F.lit("Home").alias("anchor"), F.col("url").alias("link"))).alias("sublink")).alias("links"))
    pages.write.format("xml").option("rowTag", "doc").option("rootTag", "feed").option("compression", "gzip").save(path)
    return loaders.read_wiki_xml(spark, path, strict=True).select("title", "url", "abstract", F.get("sublinks", F.lit(0))["link"].alias("first_link"), F.size("sublinks").alias("links"))


# scalar functions


@named
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    return _table(spark, folder, "part").select(
        "p_partkey",
        scalar.text_id(name).alias("text_id"),
        scalar.sha256(name).alias("sha256"),
        scalar.common_prefix_length(name, kind).alias("prefix"),
        scalar.merge_strings(name, kind).alias("merged"),
        F.get(scalar.split_strings(scalar.merge_strings(name, kind)), F.lit(1)).alias("split"),
        scalar.token_kind(scalar.typed_token(name, kind)).alias("kind"),
        scalar.token_of(scalar.typed_token(name, kind)).alias("token"),
        scalar.tag_of(scalar.with_tag(F.col("p_partkey"), F.col("p_size"))).cast("int").alias("tag"),
        scalar.from_little_endian(scalar.little_endian(F.col("p_partkey"))).alias("same"),
    )


def _token_ids(spark: SparkSession, folder: str, token: str) -> DataFrame:
    return _postings(spark, folder).filter(F.col("token") == token).select("doc_id")


@named
def union_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _token_ids(spark, folder, SHORT_TOKENS[0]).union(_token_ids(spark, folder, SHORT_TOKENS[1])).distinct()


@named
def intersect_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _token_ids(spark, folder, SHORT_TOKENS[0]).intersect(_token_ids(spark, folder, SHORT_TOKENS[1]))


@named
def id_set_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted union and intersection of the word sets of a part's name and type."""
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return _table(spark, folder, "part").select("p_partkey", F.array_join(scalar.union_sorted(a, b), " ").alias("any"), F.array_join(scalar.intersect_sorted(a, b), " ").alias("both"), scalar.contains(a, F.lit("blue")).alias("has_blue"))
