"""DuckDB SQL that the search queries must equal."""

import unicodedata

_WEIGHTS = {"title": 4.0, "summary": 2.0, "body_l2": 1.5, "body_l3": 1.0}
#: Letters that decompose into one of a to z and one mark, and the bare letters.
_MARKED = [(chr(c), d.split()) for c in range(0xC0, 0x1F00) if (d := unicodedata.decomposition(chr(c))) and "<" not in d]
_MARKED = [(c, chr(int(d[0], 16))) for c, d in _MARKED if len(d) == 2 and 0x61 <= int(d[0], 16) <= 0x7A]
_TOK = (r"regexp_extract_all(translate(lower({}), '" + "".join(c for c, _ in _MARKED) + "', '" + "".join(b for _, b in _MARKED) + r"'), '[\p{{L}}\p{{N}}]+')").format
_PLAIN_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_TEXTS = "SELECT id AS query_id, nfc_normalize(concat_ws(' ', title, summary)) AS text FROM (SELECT DISTINCT id, title, summary FROM fts) WHERE id % 100 = 0"
_ROWS = "SELECT id, " + ", ".join(f"nfc_normalize(coalesce({c}, '')) AS {c}" for c in _WEIGHTS) + " FROM (SELECT DISTINCT * FROM fts) WHERE id IS NOT NULL"
_CURRENT = """SELECT repo_id, doc_id, section_id, id FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, doc_id, section_id ORDER BY delivered_at DESC, id DESC) AS rn
    FROM sections WHERE snapshot_no = (SELECT max(snapshot_no) FROM sections)) WHERE rn = 1"""
_TAGGED = f"SELECT c.id FROM ({_CURRENT}) c WHERE EXISTS (SELECT 1 FROM doc_tags t WHERE t.repo_id = c.repo_id AND t.doc_id = c.doc_id AND lower(trim(tag)) IN ('lang-vi', 'dom-hr'))"
_WHITE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _bm25_sql(texts: str = _TEXTS, only: str = "") -> str:
    hits = " UNION ALL ".join(f"SELECT id, unnest({_TOK(c)}) AS token, {w} AS w FROM rows" for c, w in _WEIGHTS.items())
    length = " + ".join(f"len({_TOK(c)})" for c in _WEIGHTS)
    return f"""asked AS ({texts}), rows AS ({_ROWS}),
    terms AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_TOK('text')}) AS token FROM asked) GROUP BY ALL),
    sized AS (SELECT id, {length} AS dl FROM rows), total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
    freq AS (SELECT id, token, sum(w) AS f FROM ({hits}) WHERE token IN (SELECT token FROM terms) GROUP BY ALL),
    idf AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avgdl
            FROM (SELECT token, count(*) AS df FROM freq GROUP BY token), total),
    scored AS (SELECT query_id, id, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
               FROM freq JOIN sized USING (id) JOIN idf USING (token) JOIN terms USING (token) {only} GROUP BY ALL),
    keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 50)"""


def _knn_sql(floor: str = "", most: int = 50) -> str:
    return f"""near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance
        FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near {floor}) WHERE rank <= {most})"""


_FLOOR = "WHERE 1 / (1 + distance) >= 0.6"
_FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM (
        SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, CASE WHEN count(DISTINCT leg) > 1 THEN 'hybrid' ELSE min(leg) END AS mode
        FROM (SELECT query_id, id, rank, 'keyword' AS leg FROM keyword UNION ALL SELECT query_id, id, rank, 'semantic' FROM semantic) GROUP BY query_id, id))"""
_FIT = """SELECT *, sum(over_) OVER (PARTITION BY query_id ORDER BY rank) AS past FROM (
        SELECT *, CASE WHEN row_number() OVER w = 1 OR (sum(tokens) OVER w <= {budget} AND sum(tokens) OVER w - tokens < {budget}) THEN 0 ELSE 1 END AS over_
        FROM {source} WINDOW w AS (PARTITION BY query_id ORDER BY rank))"""
_SIZE = "CAST(floor((length(coalesce({}, '')) + 3) / 4) AS BIGINT)".format
_LEGS = f"{_bm25_sql()}, {_knn_sql(_FLOOR)}"
_NAMED = f"""named AS (SELECT f.*, c.repo_id, c.doc_id, c.section_id, t.title, t.body_l2, coalesce(t.body_l3, '') AS l3, {_PLAIN_TOK("coalesce(a.text, '')")} AS terms
              FROM fused f JOIN ({_CURRENT}) c USING (id) JOIN (SELECT DISTINCT * FROM fts WHERE body_l2 <> '') t USING (id) LEFT JOIN asked a USING (query_id)),
    hit AS (SELECT *, CASE WHEN mode <> 'semantic' AND len(list_filter(terms, lambda x: contains(lower(body_l2), x))) = 0 THEN list_filter(terms, lambda x: contains(lower(l3), x))[1] END AS term FROM named),
    placed AS (SELECT *, greatest(1, instr(lower(l3), term) - 150) AS a, least(length(l3), instr(lower(l3), term) + length(term) - 1 + 150) AS b FROM hit),
    shown AS (SELECT *, CASE WHEN term IS NULL THEN '' ELSE (CASE WHEN a > 1 THEN '…' ELSE '' END) || regexp_replace(substr(l3, a, b - a + 1), '^{_WHITE}|{_WHITE}$', '', 'g') || (CASE WHEN b < length(l3) THEN '…' ELSE '' END) END AS snippet FROM placed),
    weighed AS (SELECT *, {_SIZE('body_l2')} + {_SIZE('snippet')} AS tokens FROM shown),
    results AS (SELECT * FROM ({_FIT.format(budget=2000, source='weighed')}) WHERE past = 0)"""

ORACLE = {
    "index_postings": f"WITH rows AS ({_ROWS}) SELECT id, field, token, count(*) AS tf FROM ("
    + " UNION ALL ".join(f"SELECT id, '{c}' AS field, unnest({_TOK(c)}) AS token FROM rows" for c in _WEIGHTS)
    + ") GROUP BY ALL",
    "index_refresh": f"WITH rows AS ({_ROWS}), sized AS (SELECT id, " + " + ".join(f"len({_TOK(c)})" for c in _WEIGHTS) + " AS dl FROM rows) SELECT id, token, sum(w) AS f, any_value(dl) AS dl FROM ("
    + " UNION ALL ".join(f"SELECT id, unnest({_TOK(c)}) AS token, {w}::DOUBLE AS w FROM rows" for c, w in _WEIGHTS.items())
    + ") JOIN sized USING (id) GROUP BY id, token",
    "bm25_top50": f"WITH {_bm25_sql()} SELECT query_id, id, round(score, 6) AS score, rank FROM keyword",
    "folded_search": f"WITH {_bm25_sql('SELECT * FROM (VALUES (1::BIGINT, $$phep$$), (2, $$ech$$), (3, $$Securite$$), (4, $$prufung$$)) AS v(query_id, text)')} SELECT query_id, id, round(score, 6) AS score, rank FROM keyword",
    "tag_filtered_bm25": f"WITH {_bm25_sql(only=f'WHERE id IN ({_TAGGED})')} SELECT query_id, id, round(score, 6) AS score, rank FROM keyword",
    "knn_top50": f"WITH {_knn_sql()} SELECT query_id, id, round(distance, 6) AS distance, rank FROM semantic",
    "knn_floor": f"WITH {_knn_sql(_FLOOR)} SELECT query_id, id, round(1 / (1 + distance), 6) AS similarity, rank FROM semantic",
    "knn_filtered": f"""WITH {_knn_sql(most=200)} SELECT * FROM (SELECT query_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
        FROM semantic WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)) WHERE rank <= 50""",
    "rrf_hybrid": f"WITH {_LEGS}, {_FUSED} SELECT query_id, id, round(score, 9) AS score, mode, rank FROM fused",
    "search_hybrid": f"""WITH {_LEGS}, {_FUSED}, {_NAMED}
    SELECT query_id, rank, id, round(score, 9) AS score, mode, title, repo_id || ':' || doc_id || ' §' || section_id AS citation, snippet, tokens FROM results""",
    "budget_cut": f"""WITH sized AS (SELECT c.repo_id || '/' || c.doc_id AS query_id, id, id AS rank, {_SIZE('body_l2')} AS tokens
              FROM ({_CURRENT}) c JOIN (SELECT DISTINCT * FROM fts) USING (id))
    SELECT query_id, id, tokens FROM ({_FIT.format(budget=500, source='sized')}) WHERE past = 0""",
    "snippet_window": f"""WITH rows AS ({_ROWS}), hit AS (
      SELECT *, list_filter(['reconciliation', 'mirror', 'báo'], lambda t: contains(lower(body_l3), t))[1] AS term FROM rows
      WHERE NOT (contains(lower(body_l2), 'reconciliation') OR contains(lower(body_l2), 'mirror') OR contains(lower(body_l2), 'báo'))),
    placed AS (SELECT *, greatest(1, instr(lower(body_l3), term) - 150) AS a, least(length(body_l3), instr(lower(body_l3), term) + length(term) - 1 + 150) AS b FROM hit WHERE term IS NOT NULL)
    SELECT id, (CASE WHEN a > 1 THEN '…' ELSE '' END) || regexp_replace(substr(body_l3, a, b - a + 1), '^{_WHITE}|{_WHITE}$', '', 'g') || (CASE WHEN b < length(body_l3) THEN '…' ELSE '' END) AS snippet FROM placed""",
    "truncation_flags": f"""WITH {_LEGS} SELECT query_id, leg, count(*) AS n, count(*) >= 50 AS truncated
    FROM (SELECT query_id, 'keyword' AS leg FROM keyword UNION ALL SELECT query_id, 'semantic' FROM semantic) GROUP BY query_id, leg""",
    "ambiguity_pairs": f"""WITH {_LEGS}, {_FUSED}, {_NAMED},
    best AS (SELECT r.*, k.score AS bm25, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS nth FROM results r LEFT JOIN keyword k USING (query_id, id))
    SELECT a.query_id, CASE WHEN a.doc_id = b.doc_id AND a.section_id = b.section_id THEN 'mirrored' ELSE 'score' END AS reason
    FROM best a JOIN best b ON a.query_id = b.query_id AND a.nth = 1 AND b.nth = 2
    WHERE (a.doc_id = b.doc_id AND a.section_id = b.section_id) OR (a.mode = 'keyword' AND b.mode = 'keyword' AND round(a.bm25, 9) > 0 AND round(b.bm25, 9) = round(a.bm25, 9))""",
    "missing_vectors": """SELECT id, coalesce(title, '') || chr(10) || coalesce(summary, '') || (CASE WHEN coalesce(body_l2, '') <> '' THEN chr(10) || substr(body_l2, 1, 500) ELSE '' END) AS text
    FROM (SELECT DISTINCT * FROM fts) WHERE id NOT IN (SELECT vec_id FROM embeddings)""",
    "token_counts": f"SELECT token, sum(n) AS n, count(*) AS docs FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_PLAIN_TOK('nfc_normalize(text)')}) AS token FROM documents) GROUP BY ALL) GROUP BY token",
}
