"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark plans: offsets by window sums, the stemmer
as one CTE per step with the CV string recomputed by a fold at every step,
and phrases checked by a recursive chain of self-joins rather than start votes.
Tables ``documents`` and ``benchmark`` are views registered by the driver.
"""

from __future__ import annotations

from phrasedex.functions.porter import STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES
from phrasedex.operators.queries import CLAUSE, CLAUSE_ID_SPAN
from phrasedex.sources.corpus import HEADER_PATTERN, STOP_WORDS

WS = "[ \\t\\n\\x0B\\f\\r]+"
NL = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cv(x: str) -> str:
    return (
        f"list_reduce(string_split({x}, ''), lambda a, c: a || CASE WHEN c IN ('a','e','i','o','u') THEN 'v' "
        "WHEN c = 'y' THEN (CASE WHEN a = '' OR right(a, 1) = 'v' THEN 'c' ELSE 'v' END) ELSE 'c' END, '')"
    )


def m(x: str) -> str:
    return f"((length({x}) - length(replace({x}, 'vc', ''))) // 2)"


def cut(x: str, n) -> str:
    return f"left({x}, length({x}) - ({n}))"


def cvc_end(w: str, c: str) -> str:
    return f"(length({w}) >= 3 AND right({c}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w','x','y'))"


def _rule_case(rules, min_m: int) -> str:
    parts = []
    for suffix, rep in rules:
        n = len(suffix)
        parts.append(
            f"WHEN ends_with(w, {_q(suffix)}) THEN (CASE WHEN {m(cut('cv', n))} > {min_m} "
            f"THEN {cut('w', n)} || {_q(rep)} ELSE w END)"
        )
    return "CASE " + " ".join(parts) + " ELSE w END"


def _step4_case() -> str:
    parts = []
    for suffix in STEP4_SUFFIXES:
        n = len(suffix)
        cond = f"ends_with(w, {_q(suffix)})"
        if suffix == "ion":
            cond += " AND length(w) >= 4 AND substr(w, length(w) - 3, 1) IN ('s','t')"
        parts.append(f"WHEN {cond} THEN (CASE WHEN {m(cut('cv', n))} > 1 THEN {cut('w', n)} ELSE w END)")
    return "CASE " + " ".join(parts) + " ELSE w END"


def stemmer_ctes(src: str) -> str:
    """CTEs turning ``src(run)`` (distinct letter runs) into ``stems(run, stem)``."""
    eed = "ends_with(w, 'eed')"
    ed = f"ends_with(w, 'ed') AND contains({cut('cv', 2)}, 'v')"
    ing = f"ends_with(w, 'ing') AND contains({cut('cv', 3)}, 'v')"
    return f"""
st0 AS (SELECT run, run AS w FROM {src}),
st1 AS (SELECT run, CASE WHEN ends_with(w, 'sses') THEN {cut('w', 2)}
                         WHEN ends_with(w, 'ies') THEN {cut('w', 2)}
                         WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 1)}
                         ELSE w END AS w FROM st0),
st2 AS (SELECT run, w, {cv('w')} AS cv FROM st1),
st3 AS (SELECT run,
          CASE WHEN {eed} THEN (CASE WHEN {m(cut('cv', 3))} > 0 THEN {cut('w', 1)} ELSE w END)
               WHEN {ed} THEN {cut('w', 2)}
               WHEN {ing} THEN {cut('w', 3)}
               ELSE w END AS w,
          (NOT {eed}) AND (({ed}) OR ({ing})) AS fix
        FROM st2),
st4 AS (SELECT run, w, fix, {cv('w')} AS cv FROM st3),
st5 AS (SELECT run,
          CASE WHEN NOT fix THEN w
               WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
               WHEN length(w) >= 2 AND right(w, 1) = substr(w, length(w) - 1, 1) AND right(cv, 1) = 'c'
                    THEN (CASE WHEN right(w, 1) IN ('l','s','z') THEN w ELSE {cut('w', 1)} END)
               WHEN {m('cv')} = 1 AND {cvc_end('w', 'cv')} THEN w || 'e'
               ELSE w END AS w
        FROM st4),
st6 AS (SELECT run, w, {cv('w')} AS cv FROM st5),
st7 AS (SELECT run, CASE WHEN ends_with(w, 'y') AND contains({cut('cv', 1)}, 'v') THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM st6),
st8 AS (SELECT run, w, {cv('w')} AS cv FROM st7),
st9 AS (SELECT run, {_rule_case(STEP2_RULES, 0)} AS w FROM st8),
st10 AS (SELECT run, w, {cv('w')} AS cv FROM st9),
st11 AS (SELECT run, {_rule_case(STEP3_RULES, 0)} AS w FROM st10),
st12 AS (SELECT run, w, {cv('w')} AS cv FROM st11),
st13 AS (SELECT run, {_step4_case()} AS w FROM st12),
st14 AS (SELECT run, w, {cv('w')} AS cv FROM st13),
st15 AS (SELECT run,
           CASE WHEN ends_with(w, 'e') AND ({m('cv')} > 1 OR ({m('cv')} = 1 AND NOT {cvc_end(cut('w', 1), cut('cv', 1))}))
                THEN {cut('w', 1)} ELSE w END AS w FROM st14),
st16 AS (SELECT run, w, {cv('w')} AS cv FROM st15),
st17 AS (SELECT run, CASE WHEN ends_with(w, 'll') AND {m('cv')} > 1 THEN {cut('w', 1)} ELSE w END AS w FROM st16),
stems AS (SELECT run, CASE WHEN length(run) <= 2 THEN run ELSE w END AS stem FROM st17)"""


def vocab_ctes(words_src: str) -> str:
    """``vocab(word, stem)`` for the distinct words of ``words_src(word)``."""
    return f"""
vw AS (SELECT DISTINCT word FROM {words_src} WHERE word <> ''),
vr AS (SELECT word, r['i'] AS i, r['run'] AS run
       FROM (SELECT word, unnest(list_transform(regexp_extract_all(word, '[a-z]+|[0-9]+'), lambda x, i: {{'i': i, 'run': x}})) AS r FROM vw)),
letter_runs AS (SELECT DISTINCT run FROM vr WHERE regexp_matches(run, '^[a-z]')),
{stemmer_ctes('letter_runs')},
vocab AS (SELECT vr.word, string_agg(COALESCE(stems.stem, vr.run), '' ORDER BY vr.i) AS stem
          FROM vr LEFT JOIN stems ON vr.run = stems.run GROUP BY vr.word)"""


def bucket(term: str) -> str:
    return f"(CASE WHEN left({term}, 1) >= 'a' THEN ascii({term}) - 97 ELSE ascii({term}) - 48 END)::INT"


def norm_words(x: str) -> str:
    return f"list_filter(string_split(lower(regexp_replace({x}, '[^a-zA-Z0-9 ]', ' ', 'g')), ' '), lambda s: s <> '')"


def tokens_ctes(docs_sql: str) -> str:
    return TOKENS.replace("SELECT doc_id, text AS body FROM documents", docs_sql, 1)


TOKENS = f"""
docs AS (SELECT doc_id, text AS body FROM documents),
tl AS (SELECT doc_id, list_filter(regexp_split_to_array(body, {_q(WS)}), lambda x: x <> '') AS toks FROM docs),
tu AS (SELECT doc_id, unnest(list_transform(toks, lambda x, i: {{'ord': i - 1, 'raw': x}})) AS t FROM tl),
toks AS (SELECT doc_id, t['ord']::INT AS ord, t['raw'] AS raw,
                COALESCE(SUM(length(t['raw']) + 1) OVER (PARTITION BY doc_id ORDER BY t['ord']
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
         FROM tu),
words AS (SELECT doc_id, pos, unnest({norm_words('raw')}) AS word FROM toks)"""

PHRASES = f"""
phr AS (SELECT (item_id * {CLAUSE_ID_SPAN} + c['i'] - 1)::BIGINT AS query_id, c['q'] AS query
        FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, {_q(CLAUSE)}, 1), lambda x, i: {{'i': i, 'q': x}})) AS c
              FROM benchmark)),
pw AS (SELECT query_id, {norm_words('query')} AS ws FROM phr),
pq0 AS (SELECT query_id, len(ws) AS n_terms, unnest(list_transform(ws, lambda x, i: {{'k': i - 1, 'word': x}})) AS t FROM pw WHERE len(ws) > 0),
pq1 AS (SELECT query_id, t['k']::INT AS k, t['word'] AS word, length(t['word'])::INT AS word_len, n_terms::INT AS n_terms FROM pq0)"""

ALL_WORDS = """
allw AS (SELECT word FROM words UNION SELECT word FROM pq1)"""

STEMMED = """
stemmed AS (SELECT w.doc_id, w.pos, v.stem AS term FROM words w JOIN vocab v ON w.word = v.word),
post AS (SELECT term, doc_id, list_sort(list(pos)) AS positions FROM stemmed GROUP BY term, doc_id)"""

PARSED = f"""
pq AS (SELECT q.query_id, q.k, q.word, v.stem AS term, q.word_len,
              COALESCE(SUM(q.word_len + 1) OVER (PARTITION BY q.query_id ORDER BY q.k
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset,
              q.n_terms, {bucket('v.stem')} AS bucket
       FROM pq1 q JOIN vocab v ON q.word = v.word)"""

SEARCH = """
lk AS (SELECT q.query_id, q.k, p.doc_id, p.positions, q.start_offset, q.n_terms, q.word_len
       FROM pq q JOIN post p ON p.term = q.term),
cand AS (SELECT query_id, doc_id FROM lk GROUP BY query_id, doc_id HAVING count(DISTINCT k) = max(n_terms)),
lkp AS (SELECT lk.query_id, lk.doc_id, lk.k, lk.word_len, lk.n_terms, unnest(list_distinct(lk.positions)) AS pos
        FROM lk JOIN cand ON lk.query_id = cand.query_id AND lk.doc_id = cand.doc_id),
chain AS (SELECT query_id, doc_id, k, pos AS start_pos, pos, CAST(NULL AS BIGINT) AS prev_pos, word_len, n_terms
          FROM lkp WHERE k = 0
          UNION ALL
          SELECT c.query_id, c.doc_id, n.k, c.start_pos, n.pos, c.pos AS prev_pos, n.word_len, c.n_terms
          FROM chain c JOIN lkp n
            ON n.query_id = c.query_id AND n.doc_id = c.doc_id AND n.k = c.k + 1 AND n.pos = c.pos + c.word_len + 1),
pm AS (SELECT DISTINCT query_id, doc_id, start_pos FROM chain WHERE k = n_terms - 1)"""


def _with(*blocks: str, recursive: bool = False) -> str:
    body = ",\n".join(b.strip("\n") for b in blocks)
    return ("WITH RECURSIVE\n" if recursive else "WITH\n") + body + "\n"


def _stop_list() -> str:
    return ", ".join(_q(w) for w in STOP_WORDS)


_DOC_SEGMENT = (
    "'<doc id=\"' || doc_id::VARCHAR || '\" url=\"http://x?curid=' || doc_id::VARCHAR || '\" title=\"' || "
    "COALESCE(lang, '') || ' ' || COALESCE(source, '') || '\" nonfiltered=\"1\" dbindex=\"0\">' || chr(10) || "
    "COALESCE(text, '') || chr(10)"
)

_CORPUS_VOCAB = _with(TOKENS, vocab_ctes("words"), STEMMED)
_FULL = _with(TOKENS, PHRASES, ALL_WORDS, vocab_ctes("allw"), STEMMED, PARSED, SEARCH, recursive=True)

ORACLE_SQL: dict[str, str] = {
    "marked_documents": f"""
SELECT CAST(regexp_extract(seg, 'id="([0-9]+)"', 1) AS BIGINT) AS doc_id,
       regexp_replace(seg, {_q(HEADER_PATTERN)}, '') AS body
FROM (SELECT {_DOC_SEGMENT} AS seg FROM documents)
WHERE regexp_matches(seg, {_q(HEADER_PATTERN)})""",
    "clean_documents": f"""
SELECT doc_id,
       array_to_string(list_transform(list_filter(string_split(text, {NL}), lambda ln: ln <> ''), lambda ln:
           array_to_string(list_filter(regexp_split_to_array(ln, {_q(WS)}),
                           lambda t: t <> '' AND (ends_with(t, '>') OR lower(t) NOT IN ({_stop_list()}))), ' ')
           || CASE WHEN len(list_filter(regexp_split_to_array(ln, {_q(WS)}),
                           lambda t: t <> '' AND (ends_with(t, '>') OR lower(t) NOT IN ({_stop_list()})))) > 0 THEN ' ' ELSE '' END
           || {NL}), '') AS body
FROM documents""",
    "token_positions": _with(TOKENS) + "SELECT doc_id, ord, raw, pos FROM toks",
    "terms": _with(TOKENS) + "SELECT doc_id, pos, word FROM words",
    "stem_vocabulary": _CORPUS_VOCAB + "SELECT word, stem FROM vocab",
    "stemmed_terms": _CORPUS_VOCAB + "SELECT doc_id, pos, term FROM stemmed",
    "postings": _CORPUS_VOCAB + "SELECT term, doc_id, array_to_string(positions, ':') AS positions FROM post",
    "inverted_index": _CORPUS_VOCAB + """
SELECT term, (doc_id // 1024)::BIGINT AS block,
       string_agg(doc_id::VARCHAR || '|' || array_to_string(positions, ':'), ',' ORDER BY doc_id) AS postings
FROM post GROUP BY term, doc_id // 1024""",
    "postings_bounded_vocabulary": _CORPUS_VOCAB + "SELECT term, doc_id, array_to_string(positions, ':') AS positions FROM post",
    "merge_postings": _CORPUS_VOCAB + "SELECT term, doc_id, array_to_string(positions, ':') AS positions FROM post",
    "postings_text": _CORPUS_VOCAB + f"""
SELECT {bucket('term')} AS bucket, term, (doc_id // 1024)::BIGINT AS block,
       term || ' ' || string_agg(doc_id::VARCHAR || '|' || array_to_string(positions, ':'), ',' ORDER BY doc_id) AS line
FROM post GROUP BY term, doc_id // 1024""",
    "postings_text_tab": _CORPUS_VOCAB + f"""
SELECT {bucket('term')} AS bucket, term, (doc_id // 1024)::BIGINT AS block,
       term || ' ' || chr(9) || string_agg(doc_id::VARCHAR || ':' || array_to_string(positions, ':'), ',' ORDER BY doc_id) AS line
FROM post GROUP BY term, doc_id // 1024""",
    "postings_text_roundtrip": _CORPUS_VOCAB + "SELECT term, doc_id, array_to_string(positions, ':') AS positions FROM post",
    "parsed_queries": _FULL + "SELECT query_id, k, word, term, word_len, start_offset, n_terms, bucket FROM pq",
    "query_buckets": _FULL + "SELECT DISTINCT query_id, bucket FROM pq",
    "index_bucket_scan": _FULL + f"""
SELECT {bucket('term')} AS bucket, term, doc_id, array_to_string(positions, ':') AS positions
FROM post WHERE term IN (SELECT term FROM pq)""",
    "term_lookup": _FULL + """
SELECT query_id, k, doc_id, array_to_string(positions, ':') AS positions, start_offset, n_terms FROM lk""",
    "single_term_docs": _FULL + """
SELECT query_id, doc_id, array_to_string(positions, ':') AS positions FROM lk WHERE n_terms = 1""",
    "candidate_docs": _FULL + "SELECT query_id, doc_id FROM cand",
    "phrase_match": _FULL + "SELECT query_id, doc_id, start_pos FROM pm",
    "phrase_docs": _FULL + "SELECT query_id, doc_id, count(*) AS n_matches FROM pm GROUP BY query_id, doc_id",
    "partial_phrase_matches": _FULL + """
SELECT DISTINCT query_id, doc_id, k::INT AS step, prev_pos AS pos FROM chain WHERE k >= 1""",
}

_CONV = _with(
    tokens_ctes(f"SELECT {{'c': conv_id::BIGINT, 't': turn::BIGINT}} AS doc_id, text AS body FROM conversations"),
    PHRASES, ALL_WORDS, vocab_ctes("allw"), STEMMED, PARSED, SEARCH, recursive=True,
)
ORACLE_SQL["conversation_phrase_docs"] = _CONV + """
SELECT query_id, doc_id['c'] AS conv_id, doc_id['t'] AS turn, count(*) AS n_matches
FROM pm GROUP BY query_id, doc_id"""

_CLEAN_TOKENS = TOKENS.replace(
    "list_filter(regexp_split_to_array(body, " + _q(WS) + "), lambda x: x <> '')",
    "list_filter(regexp_split_to_array(body, " + _q(WS) + "), lambda x: x <> '' AND (ends_with(x, '>') OR lower(x) NOT IN ("
    + _stop_list() + ")))",
)
ORACLE_SQL["clean_postings"] = _with(_CLEAN_TOKENS, vocab_ctes("words"), STEMMED) + (
    "SELECT term, doc_id, array_to_string(positions, ':') AS positions FROM post"
)

ORACLE_SQL["candidate_docs_bitmap"] = ORACLE_SQL["candidate_docs"]
ORACLE_SQL["phrase_match_next_words"] = ORACLE_SQL["phrase_match"]
ORACLE_SQL["batch_phrase_matches"] = ORACLE_SQL["phrase_match"]
ORACLE_SQL["batch_phrase_docs"] = ORACLE_SQL["phrase_docs"]
ORACLE_SQL["batch_phrase_steps"] = ORACLE_SQL["partial_phrase_matches"]
_RANKED = _CORPUS_VOCAB.rstrip() + """,
ranked AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 64)::BIGINT AS block FROM post)
"""
_RANKED_LIST = "string_agg(doc_id::VARCHAR || '|' || array_to_string(positions, ':'), ',' ORDER BY doc_id)"
ORACLE_SQL["inverted_index_ranked"] = _RANKED + f"SELECT term, block, {_RANKED_LIST} AS postings FROM ranked GROUP BY term, block"
ORACLE_SQL["postings_text_ranked"] = _RANKED + f"""
SELECT {bucket('term')} AS bucket, term, block, term || ' ' || {_RANKED_LIST} AS line FROM ranked GROUP BY term, block"""
ORACLE_SQL["segment_phrase_docs"] = ORACLE_SQL["phrase_docs"]
ORACLE_SQL["segment_postings"] = ORACLE_SQL["postings"]
ORACLE_SQL["search_two_roots"] = ORACLE_SQL["phrase_docs"]
ORACLE_SQL["index_sub_bucket_scan"] = ORACLE_SQL["index_bucket_scan"]
ORACLE_SQL["single_phrase_docs"] = _FULL + f"""
SELECT query_id, doc_id, count(*) AS n_matches FROM pm
WHERE query_id // {CLAUSE_ID_SPAN} = (SELECT query_id // {CLAUSE_ID_SPAN} AS item FROM phr GROUP BY item ORDER BY count(*) DESC, item LIMIT 1)
GROUP BY query_id, doc_id"""
ORACLE_SQL["phrase_file"] = _with(PHRASES) + """
SELECT row_number() OVER (ORDER BY query_id) AS query_id, query FROM phr"""
ORACLE_SQL["stopword_file"] = ORACLE_SQL["clean_documents"]
ORACLE_SQL["clean_corpus_roundtrip"] = ORACLE_SQL["clean_documents"]
