"""SQL (DuckDB's dialect) for the named queries, written from their definitions and not from their plans."""

from __future__ import annotations

from itertools import chain, combinations

from ..operators.dictionary_data import words
from ..operators.filters import LINE_MARKS

QUERY_TOKENS = ["from", "that", "this", "with"]
SHORT_TOKENS = ["that", "with"]
LONG_TOKENS = ["and", "are", "as", "at", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "with"]
CHINESE = {
    "red": "红", "blue": "蓝", "green": "绿", "small": "小", "large": "大", "hot": "热", "cold": "冷", "old": "旧", "new": "新",
    "plate": "盘子", "widget": "零件", "ring": "戒指", "rod": "杆子", "gizmo": "机器", "bolt": "螺栓", "gear": "齿轮", "anvil": "铁砧",
}

_PIECE = r"[^\s\x{0B}\x{85}\p{Z}][\p{L}\p{N}]*"
_FIELD = r"[^\s\x{0B}\x{85}\p{Z}]+"
_OTHER = r"[^\p{L}\p{N}]+"
_LINE = "[" + "".join("\\" + c if ord(c) < 128 else c for c in LINE_MARKS).replace("'", "''") + "]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return ", ".join(map(_quote, items))


def _post(name: str = "p", table: str = "documents", key: str = "doc_id", text: str = "text", where: str = "TRUE") -> str:
    return f"{name} AS (SELECT token, doc_id, count(*)::INT AS tf FROM (SELECT {key} AS doc_id, unnest(regexp_extract_all(lower({text}), '{_PIECE}')) AS token FROM {table} WHERE {where}) GROUP BY ALL)"


_P = f"WITH {_post()}"
_TALK = _post("q", "conversations", "conv_id")


def _values(items, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(x if isinstance(x, str) and x[:1] == chr(39) else str(x) for x in row) + ')' for row in items)}) AS {names}"


def _groups(tokens: list[str], sizes, sep: str) -> str:
    subsets = chain.from_iterable(combinations(sorted(tokens), r) for r in sizes)
    return "g AS (SELECT * FROM " + _values([(_quote(sep.join(s)), len(s), _quote(t)) for s in subsets for t in s], "v(token_group, size, token)") + ")"


def _boolean(tokens: list[str], sizes, sep: str) -> str:
    having = "HAVING count(DISTINCT token) = max(size)" if sep == "&" else ""
    return f"{_P}, {_groups(tokens, sizes, sep)} SELECT token_group, doc_id FROM p JOIN g USING (token) GROUP BY token_group, doc_id {having}"


def _bm25(tokens: list[str], sizes, sep: str, k1: float = 1.0, b: float = 0.5, corpus: bool = False, plus1: bool = False, qtf: dict[str, float] | None = None, with_head: bool = True) -> str:
    """The CTEs up to `ranked`."""
    having = "HAVING count(DISTINCT token) = max(size)" if sep == "&" else ""
    scope = "SELECT count(*) AS n, avg(char_length(text)) AS avg_len FROM documents" if corpus else "SELECT count(*) AS n, avg(len) AS avg_len FROM c"
    ratio = "(n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)"
    idf = f"ln(1 + {ratio})" if plus1 else f"ln({ratio})"
    boost = "CASE token " + " ".join(f"WHEN {_quote(t)} THEN {v!r}::DOUBLE" for t, v in qtf.items()) + " ELSE 1.0::DOUBLE END" if qtf else "1.0::DOUBLE"
    return f"""{_P}, {_groups(tokens, sizes, sep)},
m AS (SELECT * FROM p WHERE token IN ({_list(tokens)})),
c AS (SELECT DISTINCT m.doc_id, char_length(d.text) AS len FROM m JOIN documents d ON d.doc_id = m.doc_id),
s AS ({scope}),
f AS (SELECT token, count(*) AS df FROM m GROUP BY token),
w AS (SELECT m.doc_id, m.token, {idf} * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * len / avg_len)) * {boost} AS w FROM m JOIN c USING (doc_id) JOIN f USING (token), s),
ranked AS (SELECT token_group, doc_id, round(sum(w), 6) AS score FROM w JOIN g USING (token) GROUP BY token_group, doc_id {having})"""


_ALL4, _ALL2 = [4], [2]
_HASH_STEP = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 18446744073709551616::HUGEINT)"


def _hash(x: str) -> str:
    folded = _HASH_STEP.format(x=x)
    top = f"((({folded}) * 1481765933::HUGEINT) % 18446744073709551616::HUGEINT * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT"
    whole = f"(({top} + ({folded}) * 1284865837::HUGEINT % 18446744073709551616::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"(CASE WHEN {whole} >= 9223372036854775808::HUGEINT THEN {whole} - 18446744073709551616::HUGEINT ELSE {whole} END)::BIGINT"


_TOKEN_ROWS = "SELECT doc_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS token FROM ({})"
_LINES = f"list_filter(flatten(list_transform(string_split(text, chr(13) || chr(10)), lambda s: string_split_regex(s, '{_LINE}'))), lambda x: x <> '')"
_STOP = _list(words("en"))

SQL = {
    "tokenize_en": _TOKEN_ROWS.format(f"SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS t FROM documents"),
    "tokenize_en_stripped": _TOKEN_ROWS.format(rf"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{_PIECE}'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', '')), lambda x: x <> '') AS t FROM documents"),
    "tokenize_en_pos": f"""
WITH f AS (SELECT doc_id, unnest(range(len(w)))::INT AS field, unnest(w) AS s FROM (SELECT doc_id, regexp_extract_all(text, '{_FIELD}') AS w FROM documents)),
x AS (SELECT doc_id, field, unnest(range(len(t))) AS k, unnest(t) AS token, len(t) AS n FROM (SELECT doc_id, field, regexp_extract_all(s, '{_PIECE}') AS t FROM f))
SELECT doc_id, field, token, pos::INT AS pos FROM (
  SELECT *, coalesce(sum(char_length(token)) OVER (PARTITION BY doc_id, field ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x) WHERE k < n - 1""",
    "lowercase_tokens": f"{_P} SELECT token, sum(tf)::BIGINT AS n FROM p GROUP BY token",
    "stopword_filter": f"{_P} SELECT token, sum(tf)::BIGINT AS n FROM p WHERE token NOT IN ({_STOP}) GROUP BY token",
    "zh_line_split": _TOKEN_ROWS.format(f"SELECT doc_id, {_LINES} AS t FROM documents"),
    "zh_stop_words": f"SELECT token, count(*) AS n FROM (SELECT unnest({_LINES}) AS token FROM documents) WHERE token NOT IN ({_list(words('cn'))}) GROUP BY token",
    "zh_pause_split": f"""
WITH w AS (SELECT * FROM {_values([(i, _quote(p)) for i, p in enumerate(words('pause'))], 'v(i, w)')}),
x AS (SELECT p_partkey, p_name, min(i) AS i FROM part, w WHERE contains(p_name, w) GROUP BY ALL),
y AS (SELECT p_partkey AS doc_id, [substr(p_name, 1, instr(p_name, w) - 1), substr(p_name, instr(p_name, w) + char_length(w))] AS t FROM x JOIN w USING (i)
      UNION ALL SELECT p_partkey, [p_name] FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM x))
{_TOKEN_ROWS.format('FROM y')}""",
    "zh_nouns": f"""
WITH z AS (SELECT * FROM {_values([(_quote(a), _quote(b)) for a, b in CHINESE.items()], 'v(en, zh)')}),
n AS (SELECT zh, en FROM part JOIN z ON en = split_part(p_name, ' ', 2))
SELECT token, count(*) AS n FROM (SELECT zh || '工厂' AS token FROM n UNION ALL SELECT zh FROM n UNION ALL SELECT zh FROM n WHERE en = 'ring') GROUP BY token""",
    "dictionary_words": "SELECT * FROM (VALUES ('en', 923::BIGINT), ('cn', 1472::BIGINT), ('pause', 746::BIGINT)) AS v(name, words)",
    "build_postings": f"{_P} SELECT 'text' AS field, token, doc_id, tf FROM p",
    "build_postings_binary": f"{_P} SELECT 'text' AS field, token, doc_id, 1 AS tf FROM p",
    "posting_lists": f"{_P} SELECT token, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids, string_agg(tf, ',' ORDER BY doc_id) AS tfs FROM p GROUP BY token",
    "tf_map": f"{_P} SELECT token, count(*)::INT AS df, coalesce(max(tf) FILTER (doc_id = (SELECT min(doc_id) FROM documents)), 0)::INT AS tf_in_first FROM p GROUP BY token",
    "tf_of_token": f"{_P} SELECT d.doc_id, coalesce(tf, 0)::INT AS tf FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND token = {_quote(QUERY_TOKENS[0])}",
    "doc_stats": "SELECT 'text' AS field, doc_id, char_length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents",
    "vocab_df": f"{_P} SELECT 'text' AS field, token, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY token",
    "multi_field_build": "WITH " + ", ".join(_post(c, t, k, c) for c, t, k in (("p_name", "part", "p_partkey"), ("p_brand", "part", "p_partkey"), ("url", "pages", "page_id"), ("html", "pages", "page_id"))) + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, token, count(*) AS df, sum(tf)::BIGINT AS cf FROM {c} GROUP BY token" for c in ("p_name", "p_brand", "url", "html")),
    "merge_postings": f"{_P}, {_TALK} SELECT 'text' AS field, token, doc_id, sum(tf)::INT AS tf FROM (FROM p UNION ALL FROM q) GROUP BY token, doc_id",
    "compact_postings": f"{_P} SELECT 'text' AS field, token, doc_id, tf FROM p",
    "token_exact": f"{_P} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE token = {_quote(QUERY_TOKENS[0])} GROUP BY token",
    "token_prefix": f"{_P} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE starts_with(token, 're') AND token <> 're' GROUP BY token",
    "token_range": f"{_P} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE token >= 'ma' AND token < 'pe' GROUP BY token",
    "dict_refcount": "SELECT text AS suffix, min(doc_id) AS id, (count(*) - 1)::INT AS ref_count FROM documents GROUP BY text",
    "dict_upsert": f"{_P}, {_TALK} SELECT token, sum(tf)::BIGINT AS cf FROM (FROM p UNION ALL FROM q) GROUP BY token",
    "dict_delete": f"{_P} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE token NOT IN ({_STOP}) GROUP BY token",
    "bloom_membership": f"{_P} SELECT DISTINCT token, token IN ({_STOP}) AS found FROM p",
    "query_or": _boolean(QUERY_TOKENS, _ALL4, "|"),
    "query_and": _boolean(SHORT_TOKENS, _ALL2, "&"),
    "query_and_k": _boolean(QUERY_TOKENS, [2], "&"),
    "query_and_k_least": _boolean(QUERY_TOKENS, [2, 3, 4], "&"),
    "query_or_k": _boolean(QUERY_TOKENS, [2], "|"),
    "query_or_k_least": _boolean(QUERY_TOKENS, [2, 3, 4], "|"),
    "query_matching": f"{_P} SELECT doc_id, count(*)::INT AS matched FROM p WHERE token IN ({_list(QUERY_TOKENS)}) GROUP BY doc_id HAVING count(*) >= 2",
    "query_filtered": f"SELECT * FROM ({_boolean(QUERY_TOKENS, _ALL4, '|')}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "bm25_or": _bm25(QUERY_TOKENS, _ALL4, "|") + " SELECT * FROM ranked",
    "bm25_and": _bm25(SHORT_TOKENS, _ALL2, "&") + " SELECT * FROM ranked",
    "bm25_corpus": _bm25(QUERY_TOKENS, _ALL4, "|", corpus=True, plus1=True, qtf={t: (n * 1.75) / (n + 0.75) for t, n in zip(QUERY_TOKENS, (2.0, 1.0, 1.0, 1.0))}) + " SELECT * FROM ranked",
    "bm25_group_median": _bm25(QUERY_TOKENS, [2], "&") + " SELECT token_group, count(*) AS docs, list_sort(list(score), 'DESC')[count(*) // 2 + 1] AS group_score FROM ranked GROUP BY token_group",
    "bm25_topk": _bm25(QUERY_TOKENS, _ALL4, "|") + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token_group ORDER BY score DESC, doc_id)::INT AS rank FROM ranked) WHERE rank <= 20",
    "doc_fetch_by_id": "SELECT doc_id, text, lang FROM documents WHERE doc_id IN (3, 5, 8, 13, 1000000)",
    "doc_fetch_found": f"SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_boolean(SHORT_TOKENS, _ALL2, '&')}))",
    "doc_types": "SELECT 'document' AS doc_type, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents UNION ALL SELECT 'page', count(*), sum(strlen(html))::BIGINT FROM pages",
    "doc_id_hash": f"SELECT page_id, {_hash(chr(39) + 'wiki#' + chr(39) + ' || url')} AS id FROM pages",
    "doc_dedupe_by_hash": "SELECT sha256(text) AS id, max(doc_id) AS stored, arg_max(lang, doc_id) AS lang FROM documents GROUP BY text",
    "news_text_files": rf"SELECT 'by ' || role AS category, 'Talk ' || conv_id || ' ' || turn AS title, chr(10) || trim(regexp_replace(text, '{_OTHER}', ' ', 'g')) || chr(10) || 'End' AS content FROM conversations",
    "wiki_xml_gz": rf"SELECT 'Page ' || page_id AS title, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{_OTHER}', ' ', 'g')) AS abstract, url AS first_link, 1 AS links FROM pages",
    "scalar_functions": f"""
SELECT p_partkey, {_hash('p_name')} AS text_id, sha256(p_name) AS sha256,
  (SELECT coalesce(nullif(max(i), 0), -1)::INT FROM (SELECT unnest(range(0, least(char_length(p_name), char_length(p_type)) + 1)) AS i) WHERE substr(p_name, 1, i) = substr(p_type, 1, i)) AS prefix,
  p_name || '#' || p_type AS merged, p_type AS split, p_type AS kind, p_name AS token, p_size::INT AS tag, p_partkey AS same FROM part""",
    "union_ids": f"{_P} SELECT DISTINCT doc_id FROM p WHERE token IN ({_list(SHORT_TOKENS)})",
    "intersect_ids": f"{_P} SELECT doc_id FROM p WHERE token IN ({_list(SHORT_TOKENS)}) GROUP BY doc_id HAVING count(*) = 2",
    "id_set_arrays": "SELECT p_partkey, array_to_string(list_sort(list_distinct(a || b)), ' ') AS \"any\", array_to_string(list_sort(list_distinct(list_intersect(a, b))), ' ') AS both, list_contains(a, 'blue') AS has_blue FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)",
}


def _engine(tokens: list[str], sizes, sep: str) -> str:
    """The groups with the middle score of each."""
    middle = "m2 AS (SELECT token_group, list_sort(list(score), 'DESC')[count(*) // 2 + 1] AS group_score FROM ranked GROUP BY token_group)"
    return _bm25(tokens, sizes, sep) + f", {middle} SELECT 'text' AS field, token_group, group_score, doc_id, score FROM ranked JOIN m2 USING (token_group)"


_LATER = "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE 'obsolete words ' || text END AS text FROM documents"
SQL |= {
    "engine_query_or": _engine(QUERY_TOKENS, _ALL4, "|"),
    "engine_query_and": _engine(SHORT_TOKENS, _ALL2, "&"),
    "engine_query_and_k": _engine(QUERY_TOKENS, [2], "&"),
    "engine_query_and_k_least": _engine(QUERY_TOKENS, [2, 3, 4], "&"),
    "engine_query_or_k": _engine(QUERY_TOKENS, [2], "|"),
    "engine_query_or_k_least": _engine(QUERY_TOKENS, [2, 3, 4], "|"),
    "engine_corpus_scope": _bm25(QUERY_TOKENS, _ALL4, "|", corpus=True, plus1=True) + " SELECT * FROM ranked",
    "engine_many_tokens": _bm25(LONG_TOKENS, [len(LONG_TOKENS)], "|") + f" SELECT '8 of {'&'.join(LONG_TOKENS)}' AS token_group, doc_id, score FROM ranked WHERE doc_id IN (SELECT doc_id FROM m GROUP BY doc_id HAVING count(*) >= 8)",
    "engine_replace": f"WITH later AS ({_LATER}), {_post('p', 'later')} SELECT token, doc_id, tf, char_length(text)::BIGINT AS field_len FROM p JOIN later USING (doc_id)",
    "engine_doc_types": "SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS doc_type, count(*) AS docs FROM documents GROUP BY 1",
    "engine_ids_of_type": "SELECT doc_id FROM documents WHERE lang = 'en'",
    "engine_document_fields": "SELECT doc_id, concat_ws(' ', CASE WHEN lang IS NOT NULL THEN 'lang' END, CASE WHEN n_chars IS NOT NULL THEN 'n_chars' END, CASE WHEN source IS NOT NULL THEN 'source' END, CASE WHEN text IS NOT NULL THEN 'text' END) AS fields FROM documents",
}
SQL |= {"incremental_build": SQL["build_postings"], "stream_build_postings": SQL["vocab_df"], "engine_round_trip": SQL["bm25_or"], "engine_compact": SQL["engine_replace"]}
