"""DuckDB SQL that the store queries must equal."""

_BLANK = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$'"
_DIGEST = f"regexp_replace(lower(regexp_replace(coalesce(content_hash, ''), {_BLANK}, '', 'g')), '^sha256:', '')"
_REV = f"regexp_replace(coalesce(doc_revision, ''), {_BLANK}, '', 'g')"
_FTS = "(SELECT DISTINCT * FROM fts)"


def _at(n: str) -> str:
    return f"""(SELECT repo_id, doc_id, section_id, id, coalesce(title, '') AS title, coalesce(file, '') AS file, {_DIGEST} AS content_hash, {_REV} AS doc_revision FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, doc_id, section_id ORDER BY delivered_at DESC, id DESC) AS rn FROM sections WHERE snapshot_no = {n}) WHERE rn = 1)"""


_LAST = "(SELECT max(snapshot_no) FROM sections)"
_BEFORE = f"(SELECT max(snapshot_no) FROM sections WHERE snapshot_no < {_LAST})"
_NOW, _OLD = _at(_LAST), _at(_BEFORE)
_KIND = f"""(SELECT repo_id, CASE max(CASE WHEN title LIKE '%— tests' AND list_has_all(coalesce(tags, []), ['test', 'generated']) THEN 4
        WHEN title LIKE '%— plan' AND list_has_all(coalesce(tags, []), ['plan', 'generated']) THEN 3
        WHEN (doc_id LIKE '%-code' OR doc_id LIKE '%-svc') AND list_contains(coalesce(tags, []), 'code') THEN 2 ELSE 1 END)
        WHEN 4 THEN 'tester' WHEN 3 THEN 'ba' WHEN 2 THEN 'dev' ELSE 'kb' END AS inferred FROM docs GROUP BY repo_id)"""
_REPOS = f"""(SELECT repo_id, coalesce(CASE WHEN lower(trim(kind)) IN ('kb', 'ba', 'dev', 'tester') THEN lower(trim(kind)) END, inferred, 'kb') AS kind, published_at, fingerprint FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY delivered_at DESC, kind DESC NULLS LAST, published_at DESC NULLS LAST, fingerprint DESC NULLS LAST) AS rn
        FROM repos WHERE snapshot_no = (SELECT max(snapshot_no) FROM repos)) LEFT JOIN {_KIND} USING (repo_id) WHERE rn = 1)"""
_EST = "CAST(floor((length(coalesce({}, '')) + 3) / 4) AS BIGINT)".format
_NUM = "list_transform(string_split(section_id, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER), -1))"
_READ = f"PARTITION BY repo_id, doc_id ORDER BY {_NUM}, section_id"
_LINES = "string_split_regex({}, '\\r\\n|\\n|\\r')".format
_SEP = r"'^\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?$'"
_PROSE = (
    "regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(" + _LINES("coalesce({0}, '')") + r", lambda x: regexp_replace(x, '\s+$', '')), "
    r"lambda x: NOT regexp_matches(regexp_replace(x, '^\s+', ''), '^(\||#|<!--|Figure: |\[table omitted\]$|!\[[^\]]*\]\([^)]*\)$)')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
).format
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format
_ONE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))".format
_LENGTH = f"""SELECT id, code, n, allowed FROM (SELECT id, length(l2) AS n, greatest(120, CAST(trunc(0.35::DOUBLE * length(l3)) AS INTEGER)) AS allowed,
        CASE WHEN length(l3) > 200 AND length(l2) = 0 THEN 'empty' WHEN length(l3) > 200 AND length(l2) > greatest(120, CAST(trunc(0.35::DOUBLE * length(l3)) AS INTEGER)) THEN 'ratio'
             WHEN length(l3) > 0 AND length(l3) <= 200 AND {_ONE('l2')} <> {_ONE('l3')} THEN 'verbatim' END AS code
        FROM (SELECT id, {_PROSE('body_l2')} AS l2, {_PROSE('body_l3')} AS l3 FROM {_FTS})) WHERE code IS NOT NULL"""
_SUMMARY = "SELECT id, len(list_filter(string_split_regex(coalesce(summary, ''), '\\s+'), lambda w: w <> '')) AS n FROM " + _FTS
_SHARE = f"""SELECT id, len(list_intersect(a, b)) / len(a) AS share FROM (SELECT id, {_WORDS(_PROSE('body_l2'))} AS w, list_distinct({_WORDS(_PROSE('body_l2'))}) AS a,
        list_distinct({_WORDS("coalesce(body_l3, '')")}) AS b FROM {_FTS}) WHERE len(w) >= 20"""
_CODES = rf"""SELECT id, code FROM (SELECT id, coalesce(body_l3, '') AS l3, {_PROSE('body_l2')} AS l2, unnest(list_distinct(regexp_extract_all({_PROSE('body_l2')}, '\b([A-Z][A-Z0-9/]{{1,7}})\b', 1))) AS code FROM {_FTS})
        WHERE NOT regexp_matches(l3, '(^|[^\p{{L}}\p{{N}}_])' || code || '([^\p{{L}}\p{{N}}_]|$)')
        AND regexp_matches(l2, '(^|[^\p{{L}}\p{{N}}_])' || code || '([^\p{{L}}\p{{N}}_]|$)')"""


def _runs(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 2, 1)), lambda i: array_to_string({words}[i:i + 3], ' ')))"


def _units(level: int) -> str:
    mark = "#" * level
    return rf"""SELECT doc_id, n AS pos, section_id, title, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY n) - 1 AS occurrence, body FROM (
        SELECT doc_id, n, regexp_extract(l[a], '^{mark} (\S+)(?:[ \t]+(.*?))?[ \t]*$', 1) AS section_id, trim(regexp_extract(l[a], '^{mark} (\S+)(?:[ \t]+(.*?))?[ \t]*$', 2)) AS title,
            regexp_replace(array_to_string(l[a:b - 1], chr(10)), '^\s+|\s+$', '', 'g') AS body
        FROM (SELECT doc_id, l, unnest(range(len(s))) AS n, unnest(s) AS a, unnest(list_append(s[2:], len(l) + 1)) AS b FROM (
            SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{2,{level}}} ')) AS s FROM (SELECT doc_id, {_LINES('text')} AS l FROM documents WHERE text IS NOT NULL)))
        WHERE starts_with(l[a], '{mark} ')) WHERE section_id <> ''"""


def _outside(key: str, column: str, source: str) -> str:
    """CTEs ending in ``o``: lines outside fences. Only lines with a marker are followed one by one."""
    return rf"""m AS MATERIALIZED (SELECT *, regexp_extract(trim(line, ' ' || chr(9)), '^(`{{3,}}|~{{3,}})', 1) AS mark FROM (
            SELECT {key}, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT {key}, {_LINES(column)} AS x FROM {source} WHERE {column} IS NOT NULL))),
        k AS MATERIALIZED (SELECT {key}, pos, mark, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS n FROM m WHERE mark <> ''),
        w AS (SELECT {key}, pos, n, mark AS fence FROM k WHERE n = 1 UNION ALL SELECT k.{key}, k.pos, k.n, CASE WHEN fence = '' THEN mark WHEN left(mark, 1) = left(fence, 1) AND length(mark) >= length(fence) THEN '' ELSE fence END
            FROM w JOIN k ON k.{key} = w.{key} AND k.n = w.n + 1),
        o AS (SELECT {key}, pos, line FROM (SELECT m.*, last_value(fence IGNORE NULLS) OVER (PARTITION BY m.{key} ORDER BY m.pos) AS f FROM m LEFT JOIN w ON w.{key} = m.{key} AND w.pos = m.pos) WHERE mark = '' AND coalesce(f, '') = '')"""


_OUTSIDE = _outside("id", "body_l3", _FTS)
_ROW = r"array_to_string(list_transform(string_split(regexp_replace(r, '^\|+|\|+$', '', 'g'), '|'), lambda c: regexp_replace(trim(c), '\s+', ' ', 'g')), '|')"


def _TRANSCRIBED(least: int) -> str:
    return rf"""WITH RECURSIVE {_OUTSIDE}, r AS (SELECT id, {_ROW} AS row FROM (SELECT id, trim(line) AS r FROM o WHERE starts_with(ltrim(line), '|')) WHERE NOT regexp_matches(r, {_SEP})),
        c AS (SELECT DISTINCT id, cell FROM (SELECT id, unnest(string_split(row, '|')) AS cell FROM r) WHERE length(cell) >= 2 AND NOT regexp_matches(regexp_replace(cell, '[,.%/-]', '', 'g'), '^\p{{N}}+$')),
        e AS (SELECT id FROM c GROUP BY id HAVING count(*) >= {least}),
        l AS (SELECT id, unnest(range(len(x))) AS pos, unnest(x) AS sentence FROM (SELECT id, string_split(regexp_replace(regexp_replace({_PROSE('body_l2')}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS x FROM {_FTS} JOIN e USING (id)))
        SELECT id, pos AS at, count(*) AS n FROM l JOIN c USING (id) WHERE contains(sentence, cell) AND regexp_matches(sentence, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(cell) || '([^\p{{L}}\p{{N}}_]|$)') GROUP BY id, pos HAVING count(*) >= {least}"""


ORACLE = {
    "repo_kinds": f"SELECT * FROM {_REPOS}",
    "kind_filtered_sections": f"SELECT s.repo_id, doc_id, section_id, id FROM {_NOW} s JOIN {_REPOS} r USING (repo_id) WHERE kind IN ('kb', 'dev')",
    "section_projection": f"SELECT s.repo_id, doc_id, section_id, id, title, file, doc_revision, coalesce(kind, '') AS kind FROM {_NOW} s LEFT JOIN {_REPOS} r USING (repo_id)",
    "tag_vocab": """WITH each AS (SELECT repo_id, doc_id, ord, unnest(tags) AS raw, generate_subscripts(tags, 1) - 1 AS pos FROM (SELECT DISTINCT * FROM docs) WHERE len(tags) > 0),
        spelt AS (SELECT *, trim(raw) AS tag, lower(trim(raw)) AS key FROM each WHERE trim(raw) <> '')
        SELECT key, arg_min(tag, row(ord, repo_id, doc_id, pos, tag)) AS tag, count(DISTINCT (repo_id, doc_id)) AS docs FROM spelt GROUP BY key""",
    "doc_stats": f"""SELECT repo_id, doc_id, count(*) AS sections, sum(l1) AS l1, sum(l2) AS l2, sum(l3) AS l3, CASE WHEN sum(l3) = 0 THEN 0.0 ELSE round(100.0 * (1 - sum(l2) / sum(l3)), 6) END AS saving
        FROM {_NOW} JOIN (SELECT id, {_EST("concat_ws(chr(10), title, summary)")} AS l1, {_EST('body_l2')} AS l2, {_EST('body_l3')} AS l3 FROM {_FTS}) USING (id) GROUP BY repo_id, doc_id""",
    "store_stats": f"""SELECT 'sections' AS measure, '' AS kind, count(*) AS n FROM {_NOW} UNION ALL SELECT 'repos', kind, count(*) FROM {_REPOS} GROUP BY kind
        UNION ALL SELECT 'docs', coalesce(kind, ''), count(*) FROM (SELECT DISTINCT repo_id, doc_id FROM docs) LEFT JOIN {_REPOS} USING (repo_id) GROUP BY 2""",
    "catalog_counts": """SELECT o_custkey, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p, count_if(o_orderstatus = 'F') AS n_f, count(*) AS total,
        CAST(round_even(100.0 * count_if(o_orderstatus = 'F') / count(*), 0) AS BIGINT) AS pct FROM orders GROUP BY o_custkey""",
    "token_stats": f"""SELECT layer, min(s) AS least, median(s) AS middle, round(avg(s), 6) AS mean, max(s) AS most, count(*) AS n FROM (SELECT 'l1' AS layer, {_EST("concat_ws(chr(10), title, summary)")} AS s FROM {_FTS}
        UNION ALL SELECT 'l2', {_EST('body_l2')} FROM {_FTS} UNION ALL SELECT 'l3', {_EST('body_l3')} FROM {_FTS}) GROUP BY layer""",
    "last_publish": f"SELECT max(nullif(trim(published_at), '')) AS published_at, count(*) AS repos FROM {_REPOS}",
    "ambiguous_ids": """SELECT doc_id, string_agg(repo_id, ',' ORDER BY repo_id) AS holders FROM (SELECT lower(trim(title)) AS doc_id, repo_id FROM docs UNION SELECT doc_id, repo_id FROM docs)
        GROUP BY doc_id HAVING count(*) > 1""",
    "longest_prefix": f"""WITH s AS (SELECT repo_id, doc_id, section_id FROM {_NOW}) SELECT a.repo_id, a.doc_id, a.section_id, arg_max(b.section_id, length(b.section_id)) AS parent
        FROM s a LEFT JOIN s b ON a.repo_id = b.repo_id AND a.doc_id = b.doc_id AND (starts_with(a.section_id, b.section_id || '.') OR starts_with(a.section_id, b.section_id || '-')) GROUP BY ALL""",
    "prev_next": f"SELECT repo_id, doc_id, section_id, lag(section_id) OVER w AS prev_id, lead(section_id) OVER w AS next_id FROM {_NOW} WINDOW w AS ({_READ})",
    "chapter_starts": f"""SELECT repo_id, doc_id, section_id, file FROM (SELECT *, lag(file) OVER ({_READ}) AS b, min(file) OVER (PARTITION BY repo_id, doc_id) AS x, max(file) OVER (PARTITION BY repo_id, doc_id) AS y FROM {_NOW})
        WHERE x <> y AND file IS DISTINCT FROM b""",
    "review_queue": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey LIMIT 8",
    "content_digest": f"SELECT id, sha256(coalesce(title, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(body_l2, '') || chr(10) || coalesce(body_l3, '')) AS digest FROM {_FTS}",
    "tree_digest": f"""WITH e AS (SELECT repo_id, substr(sha256(p), 1, 3) AS bucket, p || chr(0) || '01' || content_hash || chr(0) AS r FROM (SELECT *, doc_id || '/' || file || '/' || section_id AS p FROM {_NOW})),
        b AS (SELECT repo_id, bucket, count(*) AS n, sha256(string_agg(r, '' ORDER BY r)) AS s FROM e GROUP BY ALL)
        SELECT repo_id, sum(n) AS entries, sha256(string_agg(bucket || ':' || s, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY repo_id""",
    "occurrences": f"SELECT repo_id, doc_id, section_id, title, row_number() OVER (PARTITION BY repo_id, doc_id, title ORDER BY section_id) - 1 AS occurrence FROM {_NOW}",
    "manifest_diff": f"""WITH a AS (SELECT concat_ws('/', repo_id, doc_id, section_id) AS path, content_hash AS h FROM {_NOW}), b AS (SELECT concat_ws('/', repo_id, doc_id, section_id) AS path, content_hash AS h FROM {_OLD})
        SELECT path, CASE WHEN a.h IS NULL THEN 'delete' ELSE 'copy' END AS action FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""",
    "section_diff_flags": f"""SELECT repo_id, doc_id, section_id, CASE WHEN a.title IS NULL THEN 'added' WHEN b.title IS NULL THEN 'removed' ELSE 'changed' END AS change,
        coalesce(a.content_hash <> b.content_hash, false) AS content, coalesce(a.title <> b.title, false) AS title, coalesce(a.file <> b.file, false) AS moved, coalesce(a.doc_revision <> b.doc_revision, false) AS revised
        FROM {_OLD} a FULL JOIN {_NOW} b USING (repo_id, doc_id, section_id)
        WHERE a.title IS NULL OR b.title IS NULL OR a.content_hash <> b.content_hash OR a.title <> b.title OR a.file <> b.file OR a.doc_revision <> b.doc_revision""",
    "fact_diff": """WITH d AS (SELECT DISTINCT repo_id, doc_id, lower(trim(t)) AS tag FROM (SELECT repo_id, doc_id, unnest(tags) AS t FROM docs)), t AS (SELECT DISTINCT repo_id, doc_id, lower(trim(tag)) AS tag FROM doc_tags)
        SELECT *, 'added' AS change FROM (SELECT * FROM t EXCEPT SELECT * FROM d) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM d EXCEPT SELECT * FROM t)""",
    "multiset_compare": """WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, o_orderstatus FROM orders)
        SELECT year, o_orderpriority, o_orderstatus, greatest(sum(n), 0) AS missing, greatest(-sum(n), 0) AS extra FROM (
            SELECT year + 1 AS year, o_orderpriority, o_orderstatus, 1 AS n FROM o UNION ALL SELECT year, o_orderpriority, o_orderstatus, -1 FROM o)
        WHERE year > (SELECT min(year) FROM o) AND year <= (SELECT max(year) FROM o) GROUP BY ALL HAVING sum(n) <> 0""",
    "symmetric_difference": f"""WITH a AS (SELECT repo_id, doc_id, section_id, title FROM sections WHERE snapshot_no = {_BEFORE}), b AS (SELECT repo_id, doc_id, section_id, title FROM sections WHERE snapshot_no = {_LAST})
        SELECT *, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "citation_status": f"""WITH p AS (SELECT snapshot_no AS version, repo_id, doc_id, section_id, {_DIGEST} AS h FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, repo_id, doc_id, section_id ORDER BY delivered_at DESC, {_DIGEST} DESC) AS rn FROM sections) WHERE rn = 1)
        SELECT version, p.repo_id, p.doc_id, p.section_id, CASE WHEN n.id IS NULL THEN 'broken' WHEN n.content_hash <> h THEN 'stale' ELSE 'ok' END AS status,
        CASE WHEN n.id IS NULL THEN 'gone' WHEN n.content_hash <> h THEN 'changed' ELSE '' END AS reason FROM p LEFT JOIN {_NOW} n USING (repo_id, doc_id, section_id)""",
    "ffill_page": f"""SELECT repo_id, doc_id, section_id, page, last_value(page IGNORE NULLS) OVER ({_READ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_page
        FROM {_NOW} LEFT JOIN (SELECT repo_id, doc_id, section_id, max(page) AS page FROM unit_spans GROUP BY ALL) USING (repo_id, doc_id, section_id)""",
    "page_islands": """WITH m AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice))
        SELECT l_suppkey, run, l_returnflag, count(*) AS rows FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS run FROM m) GROUP BY ALL""",
    "page_inversions": f"""SELECT repo_id, doc_id, section_id, page, before FROM (SELECT *, last_value(page IGNORE NULLS) OVER ({_READ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT repo_id, doc_id, section_id, max(page) AS page FROM unit_spans GROUP BY ALL)) WHERE page < before""",
    "sticky_phase": """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type IN ('purchase', 'signup') THEN event_type END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS phase FROM events""",
    "asof_cursor": """SELECT c.event_id, c.user_id, arg_max(s.value, (s.event_id * 7919) % 100003) AS signed FROM events c LEFT JOIN events s ON s.user_id = c.user_id AND s.event_type = 'signup' AND s.ts <= c.ts
        WHERE c.event_type = 'click' GROUP BY c.event_id, c.user_id""",
    "call_collapse": """SELECT user_id, hour, arg_min(event_type, event_id) AS event_type, arg_min(ts, event_id) AS ts, max(value) AS value, arg_max(props, row(value, -event_id)) AS props, count(*) AS rows
        FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events) GROUP BY user_id, hour""",
    "known_failures": """WITH m AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS a FROM events)
        SELECT user_id, min(ts) AS ts, arg_min(event_id, row(ts, event_id)) AS event_id, count(*) - 1 AS duplicates FROM m WHERE event_type = 'error' AND a = c GROUP BY user_id""",
    "latest_closing": "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE arg_max(event_type, row(ts, event_id)) END AS state, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY user_id",
    "ordered_distinct": "SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS kinds FROM (SELECT user_id, event_type, min(row(ts, event_id)) AS pos FROM events GROUP BY ALL) GROUP BY user_id",
    "line_split": f"SELECT doc_id, unnest(range(len(l))) AS at, unnest(l) AS line FROM (SELECT doc_id, {_LINES('text')} AS l FROM documents WHERE text IS NOT NULL)",
    "prose_projection": f"SELECT id, {_PROSE('body_l2')} AS prose FROM {_FTS}",
    "redacted_urls": "SELECT repo_id, snapshot_no, source_url AS url FROM repos",
    "quality_length": _LENGTH,
    "invented_codes": _CODES,
    "overlap_share": f"SELECT id, round(share, 6) AS share FROM ({_SHARE})",
    "shingle_coverage": f"""SELECT id, len(x) AS n, len(list_filter(x, lambda s: NOT list_contains(y, s))) AS uncovered FROM (
        SELECT id, {_runs('a')} AS x, {_runs('b')} AS y FROM (SELECT id, {_WORDS("coalesce(body_l2, '')")} AS a, {_WORDS("coalesce(body_l3, '')")} AS b FROM {_FTS})) WHERE len(x) > 0""",
    "digest_drift": f"""SELECT DISTINCT id FROM (SELECT id, {_DIGEST} AS h FROM sections) JOIN (SELECT id, sha256(coalesce(title, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(body_l2, '') || chr(10) || replace(coalesce(body_l3, ''), chr(13) || chr(10), chr(10))) AS own FROM {_FTS}) USING (id) WHERE own <> h""",
    "shared_pages": """WITH own AS (SELECT DISTINCT s.repo_id, s.doc_id, s.section_id, p.page FROM unit_spans s JOIN (SELECT DISTINCT repo_id, doc_id, page FROM pdf_pages) p
          ON p.repo_id = s.repo_id AND p.doc_id = s.doc_id AND p.page BETWEEN s.page AND greatest(coalesce(s.end_page, s.page), s.page))
        SELECT a.repo_id, a.doc_id, a.section_id, count(DISTINCT b.section_id) - 1 AS others FROM own a JOIN own b USING (repo_id, doc_id, page) GROUP BY a.repo_id, a.doc_id, a.section_id""",
    "missing_spans": f"SELECT repo_id, doc_id, section_id FROM {_NOW} EXCEPT SELECT repo_id, doc_id, section_id FROM unit_spans",
    "usage_grouping_sets": """WITH e AS (SELECT event_type, user_id, CASE WHEN k >= 10 THEN k // 10 END AS decade, CAST(round(value * 100) AS BIGINT) AS cents FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
        SELECT 'event_type' AS dimension, coalesce(event_type, 'unattributed') AS key, count(*) AS rows, sum(cents) AS cents FROM e GROUP BY event_type
        UNION ALL SELECT 'user_id', coalesce(CAST(user_id AS VARCHAR), 'unattributed'), count(*), sum(cents) FROM e GROUP BY user_id
        UNION ALL SELECT 'decade', coalesce(CAST(decade AS VARCHAR), 'unattributed'), count(*), sum(cents) FROM e GROUP BY decade UNION ALL SELECT 'total', '', count(*), sum(cents) FROM e""",
    "share_fallback": "SELECT 'cents' AS basis, round(100.0 * sum(CASE WHEN event_type = 'error' THEN round(value * 100) END) / sum(round(value * 100)), 6) AS share FROM events",
    "bucket_rank": """SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS revenue, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY l_suppkey ORDER BY revenue DESC, quantity DESC, l_suppkey LIMIT 20""",
    "dependency_waves": """WITH RECURSIVE w AS (SELECT p_partkey AS node, 1 AS wave FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, w.wave + 1 FROM w JOIN part p ON p.p_partkey > 0 AND p.p_partkey // 2 = w.node) SELECT * FROM w""",
    "dependency_closure": """WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0 UNION SELECT c.node, p.p_partkey // 2 FROM c JOIN part p ON p.p_partkey = c.needs AND p.p_partkey > 0) SELECT * FROM c""",
    "dependency_cycles": "SELECT p_partkey AS node FROM part WHERE (p_partkey // 10) % 2 = 0",
    "dependency_cycle_groups": "SELECT p_partkey AS node, max(p_partkey) OVER (PARTITION BY p_partkey // 10) AS cycle FROM part WHERE (p_partkey // 10) % 2 = 0",
    "dependency_conflicts": """WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0 UNION SELECT c.node, p.p_partkey // 2 FROM c JOIN part p ON p.p_partkey = c.needs AND p.p_partkey > 0),
        related AS (SELECT node, needs AS other FROM c WHERE node <> needs UNION SELECT needs, node FROM c WHERE node <> needs), p AS (SELECT DISTINCT p_brand AS path, p_partkey AS node FROM part)
        SELECT path, node, n - 1 - r AS others FROM (SELECT p.path, p.node, count(*) OVER (PARTITION BY p.path) AS n, coalesce(q.r, 0) AS r FROM p
            LEFT JOIN (SELECT a.path, a.node, count(*) AS r FROM p a JOIN related x ON x.node = a.node JOIN p b ON b.path = a.path AND b.node = x.other GROUP BY ALL) q USING (path, node)) WHERE n - 1 - r > 0""",
    "order_inversions": r"""WITH l AS (SELECT repo_id, doc_id, page, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT repo_id, doc_id, page, string_split_regex(page_text, '\r\n|\n|\r') AS x FROM (SELECT DISTINCT * FROM pdf_pages))),
        h AS (SELECT *, regexp_extract(line, '^(\d+(?:\.\d+)*) \S', 1) AS sid FROM l), n AS (SELECT *, string_split(sid, '.')::INTEGER[] AS own, CASE WHEN contains(sid, '.') THEN regexp_replace(sid, '\.[^.]*$', '') ELSE '' END AS parent FROM h WHERE sid <> ''),
        b AS (SELECT *, lag(own) OVER w AS before, lag(sid) OVER w AS first_id FROM n WINDOW w AS (PARTITION BY repo_id, doc_id, page, parent ORDER BY pos))
        SELECT repo_id, doc_id, page, first_id, second_id FROM (SELECT repo_id, doc_id, page, first_id, sid AS second_id, row_number() OVER (PARTITION BY repo_id, doc_id, page ORDER BY pos) AS nth FROM b WHERE own < before) WHERE nth = 1""",
    "section_units": f"SELECT doc_id, pos AS at, section_id, title, occurrence, body FROM ({_units(2)})",
    "subsections": f"SELECT doc_id, pos AS at, section_id, title, occurrence, body FROM ({_units(3)})",
    "section_slices": f"""WITH u AS ({_units(2)}), i AS ({_units(3)}), asked AS (SELECT DISTINCT doc_id, section_id FROM (SELECT doc_id, regexp_extract(unnest({_LINES('text')}), '^##+ (\\S+)', 1) AS section_id FROM documents WHERE text IS NOT NULL) WHERE section_id <> '')
        SELECT a.doc_id, a.section_id, a.occurrence, coalesce(u.body, i.body) AS body FROM (SELECT *, unnest([0, 1]) AS occurrence FROM asked) a LEFT JOIN u USING (doc_id, section_id, occurrence)
        LEFT JOIN (SELECT * FROM i WHERE occurrence = 0) i USING (doc_id, section_id, occurrence) WHERE coalesce(u.body, i.body) IS NOT NULL""",
    "unfenced_lines": f"WITH RECURSIVE {_OUTSIDE} SELECT id, pos AS at, line FROM o",
    "table_cells": rf"""WITH RECURSIVE {_OUTSIDE}, r AS (SELECT id, pos, regexp_replace(trim(line), '^\|', '') AS row FROM o WHERE starts_with(trim(line), '|') AND NOT regexp_matches(trim(line), {_SEP})),
        c AS (SELECT id, pos, string_split(replace(CASE WHEN ends_with(row, '|') AND NOT ends_with(row, '\|') THEN left(row, -1) ELSE row END, '\|', chr(1)), '|') AS x FROM r)
        SELECT id, pos AS at, unnest(range(len(x))) AS col, regexp_replace(replace(trim(unnest(x)), chr(1), '|'), '\s+', ' ', 'g') AS cell FROM c""",
    "table_blocks": rf"""WITH RECURSIVE {_OUTSIDE}, t AS (SELECT id, pos, trim(line) AS line, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM o WHERE starts_with(ltrim(line), '|')),
        g AS (SELECT id, min(pos) AS pos, list(line ORDER BY pos) AS x FROM t GROUP BY id, run)
        SELECT id, pos AS at, array_to_string(list_transform(list_filter(x, lambda r: NOT regexp_matches(r, {_SEP})), lambda r: {_ROW}), chr(10)) AS rows FROM g""",
    "transcribed_tables": _TRANSCRIBED(2),
    "build_gate": f"""SELECT DISTINCT 'length' AS rule, id FROM ({_LENGTH}) UNION ALL SELECT DISTINCT 'summary', id FROM ({_SUMMARY}) WHERE n > 25 UNION ALL SELECT DISTINCT 'codes', id FROM ({_CODES})
        UNION ALL SELECT DISTINCT 'overlap', id FROM ({_SHARE}) WHERE share < 0.45 UNION ALL SELECT DISTINCT 'tables', id FROM ({_TRANSCRIBED(4)})""",
    "slugs": r"""SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(title), '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
        regexp_replace(substr(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug_id FROM """ + _FTS,
}
