"""DuckDB twins of the queries in ``pools``.

Pages are read by regular expressions here, which suffices for the tables' well-formed markup, and texts are
folded by ``strip_accents`` and dropping what isn't ASCII, which equals NFKD to ASCII on their alphabet.
"""

_PAGES = """
WITH a AS (SELECT task_row, unnest(range(len(actions))) AS step, actions FROM tasks),
pages AS (SELECT task_row || ':' || step AS page_key, task_row, step, actions[step + 1].cleaned_html AS html FROM a
          WHERE actions[step + 1].cleaned_html <> '')"""


def _plain(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_ELEMENTS = f"""{_PAGES},
raw AS (SELECT page_key, unnest(regexp_extract_all(html, '<(?:a|button|input|select|textarea|summary)\\s[^>]*>(?:<text[^>]*>[^<]*</text>)*')) AS x FROM pages),
els AS (SELECT page_key, regexp_extract(x, '^<([a-z]+)', 1) AS tag, regexp_extract(x, 'backend_node_id="([^"]*)"', 1) AS node_id,
  {_squash(_plain("regexp_replace(x, '<[^>]*>', '', 'g')"))} AS txt, {_plain("regexp_extract(x, ' placeholder=\"([^\"]*)\"', 1)")} AS ph,
  {_plain("regexp_extract(x, ' input_value=\"([^\"]*)\"', 1)")} AS iv, {_plain("regexp_extract(x, ' name=\"([^\"]*)\"', 1)")} AS nm,
  {_plain("regexp_extract(x, ' href=\"([^\"]*)\"', 1)")} AS href, x LIKE '% href=%' AS has_href,
  CASE WHEN x LIKE '% type=%' THEN regexp_extract(x, ' type="([^"]*)"', 1) ELSE 'text' END AS kind FROM raw),
roled AS (SELECT *, CASE WHEN tag IN ('button', 'summary') THEN 'button' WHEN tag = 'a' THEN 'link' WHEN tag = 'select' THEN 'combobox'
  WHEN tag = 'textarea' THEN 'textbox' WHEN kind IN ('checkbox', 'radio') THEN kind WHEN kind IN ('button', 'submit', 'reset', 'image') THEN 'button'
  WHEN kind = 'search' THEN 'searchbox' WHEN kind = 'number' THEN 'spinbutton' ELSE 'textbox' END AS role FROM els),
done AS (SELECT *, left(coalesce(nullif(txt, ''), nullif(ph, ''), nullif(nm, ''), role), 200) AS label,
  CASE WHEN tag = 'select' THEN 'SELECT' WHEN tag = 'textarea' OR role IN ('textbox', 'searchbox', 'spinbutton', 'combobox') THEN 'CLICK,TYPE_TEXT' ELSE 'CLICK' END AS ops
  FROM roled)"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]{{2,}}')"


def stems(t: str) -> str:
    return f"list_distinct(list_transform({t}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END))"


_STOP = "['click', 'type', 'text', 'select', 'the', 'and', 'for', 'with', 'from', 'that', 'this']"
LATEST = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id, id ORDER BY captured_at DESC NULLS LAST, cand_row DESC) AS rn FROM candidates) WHERE rn = 1),
pool AS (SELECT pool_id AS pool, id, label, value, role, ops, hints, row_number() OVER (PARTITION BY pool_id ORDER BY doc_order NULLS LAST, id NULLS LAST) - 1 AS i,
  count(*) OVER (PARTITION BY pool_id) AS n FROM last)"""
_QUERIES = """
ft AS (SELECT annotation_id, arg_min({'g': confirmed_task, 'n': len(actions)}, task_row) AS t FROM tasks GROUP BY annotation_id),
q AS (SELECT annotation_id || ':' || s AS pool, g AS goal FROM (SELECT annotation_id, t.g AS g, unnest(range(t.n)) AS s FROM ft WHERE t.n > 0)
      UNION ALL SELECT 'live:' || page_id, goal FROM page_snapshots JOIN live_runs USING (run_id))"""
SCORED = f"""{LATEST},{_QUERIES},
tok AS (SELECT pool.*, {tokens("coalesce(label, '') || ' ' || coalesce(value, '')")} AS t FROM pool),
qw AS (SELECT pool, list_filter({stems(tokens("coalesce(goal, '')"))}, lambda w: NOT list_contains({_STOP}, w)) AS q FROM q),
sh AS (SELECT tok.*, CASE WHEN q IS NULL THEN [] ELSE list_intersect({stems("t")}, q) END AS s FROM tok LEFT JOIN qw USING (pool)),
df AS (SELECT pool, w, count(*) AS df FROM (SELECT pool, unnest(s) AS w FROM sh) GROUP BY 1, 2),
av AS (SELECT pool, avg(len(t)) AS avg FROM sh GROUP BY 1),
lex AS (SELECT pool, id, sum(1.0 / df) AS lex FROM (SELECT pool, id, unnest(s) AS w FROM sh) JOIN df USING (pool, w) GROUP BY 1, 2),
points AS (SELECT sh.pool, sh.id, sh.i, sh.n, sh.role, sh.ops, round(coalesce(lex, 0) * avg / greatest(len(t), 1)
  + 0.4 * CASE WHEN role IN ('textbox', 'searchbox', 'combobox') THEN 1.0 WHEN role IN ('button', 'option', 'tab', 'checkbox', 'spinbutton', 'switch') THEN 0.5 ELSE 0.0 END
  + 0.3 * (1.0 - i / greatest(n - 1, 1)), 9) AS points
  FROM sh JOIN av USING (pool) LEFT JOIN lex ON lex.pool = sh.pool AND lex.id IS NOT DISTINCT FROM sh.id)"""
_MD5 = "(('0x' || md5(website))::uhugeint % 20) = 0"
GOLD = f"""
g0 AS (SELECT task_id || ':' || step AS pool, arg_min({{'id': gold_id, 'op': gold_op, 'w': website}}, case_id) AS g FROM step_cases
  WHERE valid_gold AND task_id IS NOT NULL AND gold_id IS NOT NULL GROUP BY 1),
gold AS (SELECT pool, g.id AS gold_id, g.op AS gold_op, {_MD5.replace("website", "g.w")} AS dev FROM g0)"""

def _hex(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_extract(lower({c}), '[0-9a-f]([-_ ]?[0-9a-f]){{31}}'), '[-_ ]', '', 'g'), ''), nullif(trim(lower({c})), ''))"


#: The ranking of each gold element within the pool of its operation, task ids in one spelling.
_POOL_KEY = f"""CASE WHEN pool_id LIKE 'live:%' OR NOT regexp_matches(pool_id, '(?s)^.*:[0-9]+$') THEN pool_id
  ELSE {_hex("regexp_extract(pool_id, '(?s)^(.*):([0-9]+)$', 1)")} || ':' || regexp_extract(pool_id, '(?s)^(.*):([0-9]+)$', 2) END"""
_OP_RANKS = f"""WITH
g0 AS (SELECT {_hex("task_id")} || ':' || step AS pool, arg_min({{'id': gold_id, 'op': gold_op, 'w': website}}, case_id) AS g FROM step_cases
  WHERE valid_gold AND {_hex("task_id")} IS NOT NULL AND gold_id IS NOT NULL GROUP BY 1),
gold AS (SELECT pool, g.id AS gold_id, g.op AS gold_op, {_MD5.replace("website", "g.w")} AS dev FROM g0 WHERE g.op IS NOT NULL),
keyed AS (SELECT *, {_POOL_KEY} AS pk FROM candidates),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk, id ORDER BY captured_at DESC NULLS LAST, cand_row DESC) AS rn FROM keyed) WHERE rn = 1),
op_last AS (SELECT last.*, gold.gold_op FROM last JOIN gold ON gold.pool = pk WHERE list_contains(ops, gold.gold_op)),
pool AS (SELECT pk AS pool, id, label, value, role, ops, hints, row_number() OVER (PARTITION BY pk ORDER BY doc_order NULLS LAST, id NULLS LAST) - 1 AS i,
  count(*) OVER (PARTITION BY pk) AS n FROM op_last),
ft AS (SELECT {_hex("annotation_id")} AS annotation_id, arg_min({{'g': confirmed_task, 'n': len(actions)}}, task_row) AS t FROM tasks GROUP BY 1),
q AS (SELECT annotation_id || ':' || s AS pool, g AS goal FROM (SELECT annotation_id, t.g AS g, unnest(range(t.n)) AS s FROM ft WHERE t.n > 0)),
{SCORED.split(_QUERIES + ",")[1]},
rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY points DESC, i) - 1 AS rank FROM points),
gr AS (SELECT pool, gold_op, dev, n, rank FROM rk JOIN gold USING (pool) WHERE id = gold_id)"""
_OPTION = """coalesce(nullif(left({l}, 70), ''), nullif(coalesce(role, ''), ''), 'unnamed')
  || CASE WHEN coalesce(role, '') <> '' OR left({v}, 20) <> '' THEN ' (' || concat_ws(', ', nullif(role, ''), CASE WHEN left({v}, 20) <> '' THEN '=' || left({v}, 20) END) || ')' ELSE '' END""".format(
    l=_squash("coalesce(label, '')"), v=_squash("coalesce(value, '')")
)

SQL = {
    "html_tag_counts": f"""{_PAGES} SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""",
    "interactive_elements": f"""{_ELEMENTS} SELECT page_key, node_id, tag, role, ops, label, CASE WHEN ops LIKE '%TYPE_TEXT%' THEN left(iv, 200) ELSE '' END AS value FROM done""",
    "page_outline": f"""{_PAGES} SELECT page_key, left(array_to_string(list_filter(list_transform(regexp_extract_all(html, '<h[123][^>]*>([^<]*)</h', 1), lambda x: {_squash(_plain("x"))}), lambda x: x <> ''), ' | '), 1000) AS outline
FROM pages WHERE len(list_filter(regexp_extract_all(html, '<h[123][^>]*>([^<]*)</h', 1), lambda x: trim(x) <> '')) > 0""",
    "section_heading": f"""{_PAGES},
parts AS (SELECT page_key, unnest(string_split_regex(html, '<h1[^>]*>')) AS p, unnest(range(len(string_split_regex(html, '<h1[^>]*>')))) AS k FROM pages)
SELECT CASE WHEN k = 0 THEN '' ELSE left({_squash(_plain("regexp_extract(p, '^([^<]*)<', 1)"))}, 80) END AS section, CAST(sum(len(regexp_extract_all(p, '<a '))) AS BIGINT) AS links
FROM parts GROUP BY 1 HAVING links > 0""",
    "link_merge": f"""{_ELEMENTS},
l0 AS (SELECT page_key, label, row_number() OVER () AS pos, CASE WHEN href LIKE '/%' AND website <> '' THEN 'https://' || website || href ELSE href END AS href
  FROM done LEFT JOIN tasks ON task_row = CAST(split_part(page_key, ':', 1) AS BIGINT) WHERE tag = 'a' AND has_href),
l AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') AND href NOT LIKE '%#' THEN -1 ELSE pos END AS own FROM l0),
g AS (SELECT page_key, href, own, list(label ORDER BY pos) AS ls, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT page_key, href, ls[1] AS label, array_to_string(list_filter(list_filter(ls, lambda x, i: list_position(ls, x) = i), lambda x: x <> ls[1] AND x <> ''), '|') AS aliases, n FROM g""",
    "detour_filter": r"""SELECT website, count(*) AS n, count(*) FILTER (NOT regexp_matches(coalesce(goal, ''), '(?i)\b(edit\w*|history|revisions?|source)\b') AND
  (regexp_matches(regexp_extract(final_url, '\?([^#]*)', 1), '(^|&)action=(edit|history|raw|info)(&|$)')
   OR regexp_matches(regexp_replace(regexp_replace(final_url, '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://[^/]*', ''), '/edit(/|$)'))) AS detours
FROM live_runs WHERE final_url IS NOT NULL GROUP BY website""",
    "elements_grouped": """SELECT pool_id, id, min(cand_row) AS first_row, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(coalesce(ops, []))))), ',') AS ops
FROM candidates GROUP BY 1, 2""",
    "shortlist_top20": f"""WITH {SCORED}
SELECT pool, id, CAST(i AS INT) AS i, CAST(rank AS INT) AS rank, round(points, 6) AS points
FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY points DESC, i) - 1 AS rank FROM points) WHERE rank < 20""",
    "recall_at_k": f"""{_OP_RANKS},
sc AS (SELECT *, 'all' AS scope FROM gr UNION ALL SELECT *, 'click' FROM gr WHERE gold_op = 'CLICK'),
k AS (SELECT unnest([20, 30, 40, 60]) AS k)
SELECT dev, scope, CAST(k AS INT) AS k, count(*) AS steps, avg(CASE WHEN n <= k OR rank < k THEN 1.0 ELSE 0.0 END) AS recall FROM sc, k GROUP BY 1, 2, 3""",
    "role_lift": f"""WITH {LATEST},{GOLD}
SELECT role, count(*) AS n_pool, count(*) FILTER (id = gold_id) AS n_gold, round_even(count(*) FILTER (id = gold_id) / count(*), 4) AS rate
FROM pool JOIN gold USING (pool) WHERE NOT dev GROUP BY role""",
    "pool_terms": f"""WITH {LATEST} SELECT pool, w AS term, count(*) AS df FROM (SELECT pool, unnest({stems(tokens("coalesce(label, '') || ' ' || coalesce(value, '')"))}) AS w FROM pool) GROUP BY 1, 2""",
    "pool_lengths": f"""WITH {LATEST} SELECT pool, count(*) AS n, round(avg(len({tokens("coalesce(label, '') || ' ' || coalesce(value, '')")})), 9) AS avg_length FROM pool GROUP BY 1""",
    "option_render": f"""SELECT cand_row, {_OPTION} AS option FROM candidates""",
    "option_parse": f"""WITH o AS (SELECT role, {_OPTION} AS option FROM candidates)
SELECT role, count(*) AS n, count(*) FILTER (regexp_extract(option, '(?s)^(.*) \\(([^(),=]+)(?:, =([^()]*))?\\)$', 2) = role) AS same_role FROM o GROUP BY role""",
    "hint_words": r"""WITH c AS (SELECT unnest(flatten(list_filter(list_transform(actions, lambda a: a.neg_candidates), lambda x: x IS NOT NULL))) AS c FROM tasks),
h AS (SELECT regexp_replace(regexp_replace(left(json_extract_string(c.attributes, '$.class'), 300), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[-_.:/]+', ' ', 'g') AS h FROM c WHERE c IS NOT NULL AND json_extract_string(c.attributes, '$.class') IS NOT NULL)
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(h, ' ')) AS word FROM h) GROUP BY word""",
}
