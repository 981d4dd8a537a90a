"""DuckDB SQL for the registered queries: independent, brute-force formulations
(full query x document products, plain GROUP BYs) over the same Parquet tables.

Stems come from SQL of their own (``oracle_stem``).
"""

from __future__ import annotations

from html.entities import name2codepoint

from . import params as P
from .oracle_stem import stem_ctes

# Fixed values, stated here on their own so that an error in the engine's does not pass.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE_SPACE_CLASS = (r"\t\n\x{B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
HTML_STRIP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
# The 252 names of the older standard, by code point (the engine takes the newer list, by character).
HTML_NAMES = "MAP {" + ", ".join(f"'{name}': {code}" for name, code in name2codepoint.items()) + ", 'apos': 39}"

# RE2 has no Alphabetic property; \p{L} is the same on these tables.
RE2_TOKEN = r"\p{N}+|\p{L}[\p{L}\p{N}]*|[^" + WHITE_SPACE_CLASS + r"]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def html_decoded(expr: str) -> str:
    name = "regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1)"
    code = f"""CASE WHEN regexp_matches({name}, '^#[0-9]') THEN substr({name}, 2)::INT
                    WHEN regexp_matches({name}, '^#') THEN ('0x' || substr({name}, 3))::INT ELSE {HTML_NAMES}[{name}] END"""
    piece = f"""CASE WHEN i = 1 THEN p WHEN ({code}) IS NULL THEN '&' || p
                     ELSE chr({code}) || substr(p, length({name}) + 2) END"""
    return f"array_to_string(list_transform(string_split({expr}, '&'), lambda p, i: {piece}), '')"


def tokens_of(expr: str) -> str:
    return f"regexp_extract_all(translate(coalesce({expr}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{RE2_TOKEN}')"


def corpus_ctes(docs: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """toks(doc_id, term), tf(doc_id, term, freq), dl(doc_id, term_count),
    dfreq(term, df), nd(n)."""
    return f"""
    toks AS (SELECT {key} AS doc_id, unnest({tokens_of(text)}) AS term FROM {docs}),
    tf AS (SELECT doc_id, term, count(*) AS freq FROM toks GROUP BY doc_id, term),
    dl AS (SELECT {key} AS doc_id, len({tokens_of(text)}) AS term_count FROM {docs}),
    dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    nd AS (SELECT count(*)::DOUBLE AS n FROM {docs})"""


def query_ctes(queries: str, qkey: str, text: str) -> str:
    """qt(query_id, term), qw(query_id, term, w), qids(query_id)."""
    return f"""
    qt AS (SELECT {qkey} AS query_id, unnest({tokens_of(text)}) AS term FROM {queries}),
    qw AS (SELECT query_id, term, count(*) AS w FROM qt GROUP BY query_id, term),
    qids AS (SELECT DISTINCT {qkey} AS query_id FROM {queries})"""


def stemmed_ctes(queries: str | None = None, qkey: str = "item_id") -> str:
    """``corpus_ctes`` (and ``query_ctes``) over stems instead of tokens."""
    corpus = corpus_ctes().split("tf AS (", 1)[1]  # what follows the tokens
    raw = f"toks0 AS (SELECT doc_id, unnest({tokens_of('text')}) AS term FROM documents)"
    terms, query = "SELECT DISTINCT term FROM toks0", ""
    if queries:
        raw += f", qt0 AS (SELECT {qkey} AS query_id, unnest({tokens_of('text')}) AS term FROM {queries})"
        terms += " UNION ALL SELECT term FROM qt0"
        query = f""", qt AS (SELECT query_id, coalesce(stem, term) AS term FROM qt0 LEFT JOIN stems ON stems.raw = qt0.term),
            qw AS (SELECT query_id, term, count(*) AS w FROM qt GROUP BY query_id, term),
            qids AS (SELECT DISTINCT {qkey} AS query_id FROM {queries})"""
    return f"""{raw}, {stem_ctes(terms)},
        toks AS (SELECT doc_id, coalesce(stem, term) AS term FROM toks0 LEFT JOIN stems ON stems.raw = toks0.term),
        tf AS ({corpus}{query}"""


SCORES = f"""
    scores AS (
      SELECT qw.query_id, tf.doc_id,
             round(sum(qw.w * (tf.freq::DOUBLE / dl.term_count) * log10(nd.n / dfreq.df)), {P.RANK_DECIMALS}) AS rank,
             round(sum(qw.w * (tf.freq::DOUBLE / dl.term_count) * log10(nd.n / dfreq.df)), 12) AS exact
      FROM qw JOIN dfreq ON qw.term = dfreq.term
              JOIN tf ON tf.term = qw.term
              JOIN dl ON dl.doc_id = tf.doc_id
              CROSS JOIN nd
      GROUP BY qw.query_id, tf.doc_id)"""


def full_ranking(docs: str = "documents", key: str = "doc_id") -> str:
    """ranked(query_id, doc_id, rank, rn) over every (query, document) pair."""
    return f"""
    ranked AS (
      SELECT q.query_id, d.doc_id, coalesce(s.rank, 0.0) AS rank,
             row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.exact, 0.0) DESC, d.doc_id ASC) AS rn
      FROM qids q CROSS JOIN (SELECT {key} AS doc_id FROM {docs}) d
      LEFT JOIN scores s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)"""


def one_query(text: str) -> str:
    return f"(SELECT 0 AS query_id, {_q(text)} AS text)"


def search_sql(queries: str, qkey: str, qtext: str, docs: str = "documents", key: str = "doc_id",
               select: str = "query_id, rn, doc_id, rank", k: int = P.TOP_K) -> str:
    return f"""WITH {corpus_ctes(docs, key)}, {query_ctes(queries, qkey, qtext)}, {SCORES}, {full_ranking(docs, key)}
    SELECT {select} FROM ranked WHERE rn <= {k}"""


USER_TURNS = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
SCOPED_DOCS = "(SELECT * FROM documents WHERE source IN (" + ", ".join(_q(s) for s in P.SCOPED_SOURCES) + "))"

HTML_TEXT = f"""
    html AS (
      SELECT page_id, {html_decoded(f"regexp_replace(html, '{HTML_STRIP}', ' ', 'g')")} AS text
      FROM pages)"""

REPLACED_DOCS = """(
    SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
    UNION ALL SELECT item_id AS doc_id, text FROM benchmark)"""
FIRST_DOCS = f"(SELECT * FROM documents WHERE NOT coalesce(source >= {_q(P.DELTA_FROM_SOURCE)}, false))"
FOLDER_DOCS = "(SELECT * FROM documents WHERE lang IN ('en', 'fr', 'de'))"


def oracle_sql() -> dict[str, str]:
    c = corpus_ctes()
    return {
        "tokenize_documents": f"""
            SELECT doc_id, pos, token FROM (
              SELECT doc_id, generate_subscripts(t, 1)::BIGINT AS pos, unnest(t) AS token
              FROM (SELECT doc_id, {tokens_of('text')} AS t FROM documents))""",
        "token_kinds": f"""
            WITH {c}
            SELECT kind, count(*) AS tokens, count(DISTINCT term) AS terms FROM (
              SELECT term, CASE WHEN regexp_matches(term, '^\\p{{N}}') THEN 'number'
                                WHEN regexp_matches(term, '^\\p{{L}}') THEN 'word'
                                ELSE 'symbol' END AS kind FROM toks)
            GROUP BY kind""",
        "term_freq": f"WITH {c} SELECT doc_id, term, freq FROM tf",
        "doc_length": f"WITH {c} SELECT doc_id, term_count FROM dl",
        "doc_freq": f"WITH {c} SELECT term, df FROM dfreq",
        "corpus_stats": f"""
            WITH {c}
            SELECT 'n_docs' AS stat, count(*)::BIGINT AS value FROM dl
            UNION ALL SELECT 'n_tokens', sum(term_count)::BIGINT FROM dl
            UNION ALL SELECT 'n_terms', count(*)::BIGINT FROM dfreq
            UNION ALL SELECT 'n_postings', count(*)::BIGINT FROM tf""",
        "idf": f"""WITH {c}
            SELECT term, df, round(log10(nd.n / df), {P.RANK_DECIMALS}) AS idf FROM dfreq CROSS JOIN nd""",
        "tfidf_weights": f"""WITH {c}
            SELECT tf.doc_id, tf.term, tf.freq,
                   round(tf.freq::DOUBLE / dl.term_count, {P.RANK_DECIMALS}) AS tf,
                   round(log10(nd.n / dfreq.df), {P.RANK_DECIMALS}) AS idf,
                   round(tf.freq::DOUBLE / dl.term_count * log10(nd.n / dfreq.df), {P.RANK_DECIMALS}) AS tfidf
            FROM tf JOIN dl USING (doc_id) JOIN dfreq USING (term) CROSS JOIN nd""",
        "search_top20": search_sql(one_query(P.QUERY_TOP20), "query_id", "text", select="rn, doc_id, rank"),
        "rank_all": f"""WITH {c}, {query_ctes(one_query(P.QUERY_TOP20), 'query_id', 'text')}, {SCORES}
            SELECT d.doc_id, coalesce(s.rank, 0.0) AS rank
            FROM documents d LEFT JOIN scores s ON s.doc_id = d.doc_id""",
        "search_repeated_and_symbols": search_sql(one_query(P.QUERY_REPEATS), "query_id", "text",
                                                  select="rn, doc_id, rank"),
        "search_no_match": search_sql(one_query(P.QUERY_NO_MATCH), "query_id", "text",
                                      select="rn, doc_id, rank"),
        "search_many": f"""WITH {c}, {query_ctes('benchmark', 'item_id', 'text')}, {SCORES}
            SELECT query_id, rn, doc_id, rank FROM (
              SELECT query_id, doc_id, rank,
                     row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, doc_id ASC) AS rn
              FROM scores WHERE exact > 0)
            WHERE rn <= {P.TOP_K}""",
        "search_many_zero_fill": search_sql("benchmark", "item_id", "text"),
        "search_conversations": search_sql(
            f"(SELECT struct_pack(conv_id := conv_id, turn := turn) AS qk, text FROM {USER_TURNS})",
            "qk", "text", select="query_id.conv_id AS conv_id, query_id.turn AS turn, rn, doc_id, rank"),
        "search_many_by_documents": search_sql("benchmark", "item_id", "text"),
        "search_many_by_terms": search_sql("benchmark", "item_id", "text"),
        "search_many_stored": search_sql("benchmark", "item_id", "text"),
        "search_stored": search_sql(one_query(P.QUERY_TOP20), "query_id", "text", select="rn, doc_id, rank"),
        "search_conversations_by_documents": search_sql(
            f"(SELECT struct_pack(conv_id := conv_id, turn := turn) AS qk, text FROM {USER_TURNS})",
            "qk", "text", select="query_id.conv_id AS conv_id, query_id.turn AS turn, rn, doc_id, rank"),
        "add_to_stored_index": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "replace_in_stored_index": f"WITH {corpus_ctes(REPLACED_DOCS)} SELECT term, df FROM dfreq",
        "skip_accounting": """
            WITH files AS (
              SELECT CASE lang WHEN 'es' THEN 'unsupported extension TXT' WHEN 'en' THEN '' WHEN 'fr' THEN ''
                               WHEN 'de' THEN '' ELSE 'no extension' END AS error FROM documents
              UNION ALL
              SELECT CASE WHEN regexp_matches(html, '<(meta|br|hr|img|input)( [^>]*)?[^/]>') THEN 'malformed XML' ELSE '' END
              FROM pages)
            SELECT CASE WHEN error = '' THEN 'ok' ELSE 'skipped' END AS status, error, count(*) AS files
            FROM files GROUP BY error""",
        "query_rejects": r"""
            WITH turns AS (SELECT text FROM conversations WHERE role = 'user'),
            checked AS (
              SELECT CASE WHEN regexp_full_match(text, '(?s)([\x{0}-\x{7F}]|[^\x{0}-\x{FF}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|[\x{E0}-\x{EF}][\x{80}-\x{BF}][\x{80}-\x{BF}])*')
                          THEN 'answered' ELSE 'rejected' END AS status FROM turns WHERE text IS NOT NULL
              UNION ALL SELECT 'rejected' FROM turns WHERE text IS NULL)
            SELECT status, count(*) AS queries FROM checked GROUP BY status""",
        "stem_vocabulary": f"WITH {stemmed_ctes()} SELECT raw, stem FROM stems WHERE raw <> stem",
        "stem_doc_freq": f"WITH {stemmed_ctes()} SELECT term, df FROM dfreq",
        "search_stemmed": f"""WITH {stemmed_ctes(one_query(P.QUERY_STEMMED), "query_id")}, {SCORES}, {full_ranking()}
            SELECT rn, doc_id, rank FROM ranked WHERE rn <= {P.TOP_K}""",
        "search_many_stemmed": f"""WITH {stemmed_ctes("benchmark")}, {SCORES}, {full_ranking()}
            SELECT query_id, rn, doc_id, rank FROM ranked WHERE rn <= {P.TOP_K}""",
        "search_scoped": search_sql("benchmark", "item_id", "text", docs=SCOPED_DOCS),
        "search_result_json": f"""WITH {c}, {query_ctes('benchmark', 'item_id', 'text')}, {SCORES}, {full_ranking()}
            SELECT query_id,
                   '[' || string_agg('[' || to_json(doc_id::VARCHAR) || ',' || printf('%.6f', rank) || ']', ',' ORDER BY rn) || ']' AS result
            FROM ranked WHERE rn <= {P.TOP_K} GROUP BY query_id""",
        "search_result_lines": f"""WITH {c}, {query_ctes('benchmark', 'item_id', 'text')}, {SCORES}, {full_ranking()}
            SELECT query_id, rn, doc_id::VARCHAR || ' ' || printf('%.6f', rank) AS line
            FROM ranked WHERE rn <= {P.TOP_K}""",
        "html_text": f"WITH {HTML_TEXT} SELECT page_id, text FROM html",
        "pages_doc_freq": f"WITH {HTML_TEXT}, {corpus_ctes('html', 'page_id')} SELECT term, df FROM dfreq",
        "pages_search": f"""WITH {HTML_TEXT}, {corpus_ctes('html', 'page_id')},
            {query_ctes(one_query(P.QUERY_PAGES), 'query_id', 'text')}, {SCORES}, {full_ranking('html', 'page_id')}
            SELECT rn, doc_id AS page_id, rank FROM ranked WHERE rn <= {P.TOP_K}""",
        "index_roundtrip_parquet": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "index_roundtrip_json": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "index_roundtrip_json_object": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "merge_doc_freq": f"WITH {c} SELECT term, df FROM dfreq",
        "replace_document": f"WITH {corpus_ctes(REPLACED_DOCS)} SELECT term, df FROM dfreq",
        "duplicate_keys": f"""
            SELECT doc_id, count(*) AS copies FROM (
              SELECT doc_id FROM documents
              UNION ALL SELECT doc_id FROM documents WHERE source = {_q(P.DUPLICATED_SOURCE)})
            GROUP BY doc_id HAVING count(*) > 1""",
        "duplicate_postings": f"""WITH {c}
            SELECT doc_id, term, 2::BIGINT AS copies FROM tf
            WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = {_q(P.DUPLICATED_SOURCE)})""",
        "wrong_terms": f"""WITH {c}
            SELECT term, 1::BIGINT AS copies, df, df + n AS counted FROM dfreq JOIN (
              SELECT term, count(*) AS n FROM tf
              WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = {_q(P.DUPLICATED_SOURCE)}) GROUP BY term) USING (term)""",
        "orphan_postings": f"""WITH {c}
            SELECT doc_id, count(*) AS postings, sum(freq)::BIGINT AS tokens FROM tf
            WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = {_q(P.ORPHANED_SOURCE)})
            GROUP BY doc_id""",
        "legacy_import": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "published_index": f"WITH {c} SELECT term, df FROM dfreq",
        "surrogate_ids": """
            WITH ids AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS id FROM documents)
            SELECT count(DISTINCT doc_id) AS n_keys, count(DISTINCT id) AS n_ids,
                   (SELECT count(*) FROM (SELECT id FROM ids GROUP BY id HAVING count(DISTINCT doc_id) > 1)) AS collisions
            FROM ids""",
        "packed_postings": f"WITH {c} SELECT doc_id, term, freq, term_count FROM tf JOIN dl USING (doc_id)",
        "dense_ids": f"WITH {c} SELECT doc_id, row_number() OVER (ORDER BY term_count, doc_id) - 1 AS number FROM dl",
        "search_block_max": search_sql(one_query(P.QUERY_TOP20), "query_id", "text", select="rn, doc_id, rank"),
        "tiered_index_search": search_sql(one_query(P.QUERY_TOP20), "query_id", "text", select="rn, doc_id, rank"),
        "tiered_replace": f"WITH {corpus_ctes(REPLACED_DOCS)} SELECT term, df FROM dfreq",
        "rank_all_ordered": f"""WITH {c}, {query_ctes(one_query(P.QUERY_TOP20), 'query_id', 'text')}, {SCORES}, {full_ranking()}
            SELECT rn, doc_id, rank FROM ranked""",
        "xml_text": """
            SELECT doc_id,
                   CASE WHEN trim(t, ' ' || chr(9) || chr(10)) = '' THEN '' ELSE t || ' ' END AS text,
                   'ok' AS status
            FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t
                  FROM documents)""",
        "folder_index": f"WITH {corpus_ctes(FOLDER_DOCS)} SELECT doc_id, term, freq FROM tf",
        "stream_doc_freq": f"WITH {c} SELECT term, df FROM dfreq",
        "stream_replace": f"WITH {corpus_ctes(REPLACED_DOCS)} SELECT term, df FROM dfreq",
        "stream_state_doc_freq": f"WITH {corpus_ctes(REPLACED_DOCS)} SELECT term, df FROM dfreq",
        "stream_stemmed_doc_freq": f"WITH {stemmed_ctes()} SELECT term, df FROM dfreq",
        "stream_unique_keys": "SELECT DISTINCT doc_id FROM documents",
        "stream_search": search_sql("benchmark", "item_id", "text"),
        "stream_search_refresh": f"""
            SELECT * FROM ({search_sql("(SELECT * FROM benchmark WHERE text < 'M')", "item_id", "text", docs=FIRST_DOCS)})
            UNION ALL SELECT * FROM ({search_sql("(SELECT * FROM benchmark WHERE NOT coalesce(text < 'M', false))", "item_id", "text")})""",
    }
