"""DuckDB twins of the queries in ``extras``."""

from pagetrail.plans.pools_sql import _ELEMENTS, _PAGES, _STOP, _plain, _squash, tokens
from pagetrail.plans.runs_sql import _DECISIONS, _HISTORY

_URL_HOST = "replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', ''), '.', '[.]')"


def _canonical(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') || regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


_SECTIONED = f"""{_PAGES},
parts AS (SELECT page_key, unnest(string_split_regex(html, '<h1[^>]*>')) AS p, unnest(range(len(string_split_regex(html, '<h1[^>]*>')))) AS k, html LIKE '%<main%' AS m FROM pages),
sec AS (SELECT page_key, p, k, CASE WHEN k = 0 THEN '' ELSE left({_squash(_plain("regexp_extract(p, '^([^<]*)<', 1)"))}, 80) END AS section FROM parts)"""
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))"

SQL = {
    "request_options": """SELECT pool_id, lower(op) || '_target' AS question, count(DISTINCT id) AS options FROM (SELECT pool_id, id, unnest(ops) AS op FROM candidates) GROUP BY 1, 2 HAVING options > 1""",
    "operation_question": """WITH s AS (SELECT pool_id, list(DISTINCT op) AS s FROM (SELECT pool_id, unnest(ops) AS op FROM candidates) GROUP BY 1)
SELECT pool_id, array_to_string(list_filter(['CLICK', 'TYPE_TEXT', 'SELECT'], lambda o: list_contains(s, o)), ',') AS ops FROM s WHERE len(list_filter(['CLICK', 'TYPE_TEXT', 'SELECT'], lambda o: list_contains(s, o))) > 1""",
    "gold_distribution": """SELECT case_id, 'CLICK=' || CAST(gold_op = 'CLICK' AS INT) || ',TYPE_TEXT=' || CAST(gold_op = 'TYPE_TEXT' AS INT) || ',SELECT=' || CAST(gold_op = 'SELECT' AS INT) AS gold
FROM step_cases WHERE gold_op IS NOT NULL""",
    "element_lines": f"""{_ELEMENTS},
sx AS (SELECT page_key, k, section, p FROM (SELECT page_key, unnest(string_split_regex(html, '<h1[^>]*>')) AS p, unnest(range(len(string_split_regex(html, '<h1[^>]*>')))) AS k FROM pages) q,
  LATERAL (SELECT CASE WHEN k = 0 THEN '' ELSE left({_squash(_plain("regexp_extract(p, '^([^<]*)<', 1)"))}, 80) END AS section)),
own AS (SELECT page_key, section, unnest(regexp_extract_all(p, 'backend_node_id="([^"]*)"', 1)) AS node_id FROM sx)
SELECT page_key, node_id, concat_ws(' | ', node_id, nullif(left(label, 50), ''), role, replace(ops, ',', '/'), 'main' || CASE WHEN section <> '' THEN ' > ' || left(section, 30) ELSE '' END,
  CASE WHEN ops LIKE '%TYPE_TEXT%' AND iv <> '' THEN 'value: ' || left(left(iv, 200), 20) END) AS line FROM done JOIN own USING (page_key, node_id)""",
    "context_texts": f"""{_SECTIONED}
SELECT CASE WHEN section = '' THEN 'main' ELSE 'main > ' || left(section, 40) END AS context, CAST(sum(len(regexp_extract_all(p, '<a '))) AS BIGINT) AS n FROM sec GROUP BY 1 HAVING n > 0""",
    "visible_text": f"""{_PAGES},
x AS (SELECT page_key, list_filter(list_transform(regexp_extract_all(html, '<(?:h1|p|text)(?:\\s[^>]*)?>([^<]*)</', 1), lambda t: {_squash(_plain("t"))}), lambda t: t <> '') AS ts FROM pages),
l AS (SELECT page_key, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM x),
r AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY page_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM l)
SELECT page_key, left(string_agg(t, chr(10) ORDER BY i), 600) AS text FROM r WHERE run < 600 GROUP BY 1""",
    "capped_actions": "SELECT pool_id, least(count(*), 400) AS kept, greatest(count(*) - 400, 0) AS omitted FROM candidates GROUP BY 1",
    "top_answers": f"""WITH {_DECISIONS},
x AS (SELECT run_id, place, list_filter(d.answers, lambda a: a IS NOT NULL AND a.confidence IS NOT NULL) AS a FROM d WHERE len(d.answers) > 0),
e AS (SELECT run_id, place, unnest(a) AS a, unnest(range(len(a))) AS i FROM x),
r AS (SELECT run_id, place, coalesce(a.choice, '') AS c, row_number() OVER (PARTITION BY run_id, place ORDER BY a.confidence DESC, i) AS rn FROM e)
SELECT x.run_id, CAST(x.place AS INT) AS place, coalesce(string_agg(c, ',' ORDER BY rn) FILTER (rn <= 2), '') AS ids FROM x LEFT JOIN r ON x.run_id = r.run_id AND x.place = r.place GROUP BY 1, 2""",
    "url_checks": f"""SELECT run_id, coalesce(regexp_matches({_canonical("final_url")}, '^' || {_URL_HOST}), false) AS at_site,
coalesce(len(list_filter(coalesce(steps, []), lambda s: s IS NOT NULL AND regexp_matches({_canonical("coalesce(s.url_after, '')")}, '^' || {_URL_HOST} || '/.'))) > 0, false) AS via_page FROM live_runs WHERE url IS NOT NULL""",
    "date_forms": """SELECT cand_row, strftime(CAST(value AS DATE), '%b %-d') AS short, strftime(CAST(value AS DATE), '%B %-d') AS long FROM candidates WHERE regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(value AS DATE) IS NOT NULL
UNION ALL SELECT cand_row, NULL, NULL FROM candidates WHERE regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(value AS DATE) IS NULL""",
    "base64_tokens": "SELECT cand_row, contains(label, 'kettle') AS kettle FROM candidates WHERE label IS NOT NULL",
    "control_rule": f"""WITH {_HISTORY}, b AS (SELECT run_id, step, coalesce(lag(s.operation) OVER (PARTITION BY run_id ORDER BY step), '') AS o FROM h)
SELECT run_id, CAST(step AS INT) AS step, CASE o WHEN 'SCROLL_DOWN' THEN 'BLOCKED' WHEN 'WAIT' THEN 'SCROLL_DOWN' ELSE 'WAIT' END AS control FROM b""",
    "verdicts": """WITH v0 AS (SELECT run_id, unnest(range(len(verdicts))) AS place, verdicts FROM live_runs), v AS (SELECT run_id, place, verdicts[place + 1] AS v FROM v0 WHERE verdicts[place + 1] IS NOT NULL)
SELECT run_id, CAST(place AS INT) AS place, coalesce(v.done, false) AND coalesce(trim(v.reason) <> '', false) AS done, left(coalesce(v.reason, ''), 300) AS reason FROM v""",
    "call_stats": "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS ms FROM events GROUP BY 1",
    "status_pivot": """SELECT coalesce(category, '') AS category, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'error') AS error FROM live_runs GROUP BY 1""",
    "paired_runs": """WITH m AS (SELECT website, run_id % 2 AS k, count(*) FILTER (success) * 2 > count(*) AS ok FROM live_runs WHERE website IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(a.website, b.website) AS website, a.ok AS odd, b.ok AS even FROM (SELECT * FROM m WHERE k = 1) a FULL JOIN (SELECT * FROM m WHERE k = 0) b ON a.website = b.website""",
    "reclaimed": f"""{_PAGES} SELECT 'ancestor' AS kind, CAST(1 AS INT) AS distance, CAST(sum(len(regexp_extract_all(html, '<(?:a|button|select)\\s[^>]*><text'))) AS BIGINT) AS n FROM pages""",
    "pool_crosscheck": f"""{_ELEMENTS},
ours AS (SELECT DISTINCT page_key, node_id AS id FROM done WHERE tag = 'a'),
t0 AS (SELECT task_row, unnest(range(len(actions))) AS step, actions FROM tasks),
t1 AS (SELECT task_row || ':' || step AS page_key, unnest(list_concat(coalesce(actions[step + 1].pos_candidates, []), coalesce(actions[step + 1].neg_candidates, []))) AS c FROM t0),
theirs AS (SELECT DISTINCT page_key, c.backend_node_id AS id FROM t1 WHERE c.tag = 'a'),
o AS (SELECT 'page' AS side FROM (SELECT * FROM ours EXCEPT SELECT * FROM theirs) UNION ALL SELECT 'candidates' FROM (SELECT * FROM theirs EXCEPT SELECT * FROM ours))
SELECT side, count(*) AS n FROM o GROUP BY 1""",
    "fresh_pages": """SELECT min(page_id) AS first_page, count(*) AS n FROM page_snapshots WHERE page IS NOT NULL GROUP BY page.url, page.text, page.outline, page.scroll HAVING n > 1""",
    "reused_texts": f"""WITH {_HISTORY}, g AS (SELECT run_id, goal FROM live_runs),
t AS (SELECT run_id, step, goal, s.action AS action, s.url_before AS url, s.text AS text FROM h JOIN g USING (run_id) WHERE s.operation = 'TYPE_TEXT' AND s.text IS NOT NULL)
SELECT run_id, CAST(step AS INT) AS step, first_value(text) OVER (PARTITION BY goal, action, url ORDER BY run_id, step) AS memo FROM t""",
    "page_views": "SELECT page_id, coalesce(page.title, '') AS title, left(coalesce(page.outline, ''), 400) AS outline, left(coalesce(page.text, ''), 600) AS visible_text FROM page_snapshots",
    "label_bigrams": f"""WITH l AS (SELECT {tokens("label")} AS t FROM candidates WHERE label IS NOT NULL), p AS (SELECT unnest({_BIGRAMS}) AS pair FROM l)
SELECT pair, count(*) AS n FROM p WHERE NOT list_has_any(string_split(pair, ' '), {_STOP}) GROUP BY 1""",
    "light_stems": f"""WITH w AS (SELECT DISTINCT unnest({tokens("confirmed_task")}) AS w FROM tasks WHERE confirmed_task IS NOT NULL)
SELECT CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, -3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, -2) WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, -2)
  WHEN length(w) > 4 AND w LIKE '%ly' THEN left(w, -2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1""",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
}
