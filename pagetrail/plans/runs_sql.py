"""DuckDB twins of the queries in ``runs``."""


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _squash(f"regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


_HISTORY = """
h0 AS (SELECT run_id, url AS start, unnest(range(len(steps))) AS step, steps FROM live_runs),
h AS (SELECT run_id, start, step, steps[step + 1] AS s FROM h0 WHERE steps[step + 1] IS NOT NULL)"""
_ATTEMPTS = f"""{_HISTORY},
a0 AS (SELECT run_id, step, regexp_replace(coalesce(nullif(s.url_before, ''), s.url_after, ''), '(?s)#.*$', '') AS url,
  coalesce(nullif(s.operation, ''), 'CLICK') AS operation, {_norm("coalesce(s.action, '')")} AS label, coalesce(s.action, '') AS display,
  CASE WHEN s.url_before IS NOT NULL AND s.url_before IS DISTINCT FROM s.url_after THEN 'url_changed' WHEN coalesce(s.page_changed, false) THEN 'page_changed' ELSE 'no_change' END AS outcome FROM h),
att AS (SELECT *, outcome = 'no_change' AND operation <> 'TYPE_TEXT' AS failed FROM a0)"""
_EXCLUDED = f"""{_ATTEMPTS},
g AS (SELECT run_id, url, operation, label, bool_or(failed) AS f, count(*) AS n, arg_max(display, step) FILTER (failed) AS lf, arg_min(display, step) AS fi FROM att GROUP BY 1, 2, 3, 4),
ex AS (SELECT run_id, url, operation, label, CASE WHEN f THEN lf ELSE fi END AS display, CASE WHEN f THEN 'no effect' ELSE 'repeated' END AS reason FROM g WHERE f OR n >= 2)"""
_STREAK = f"""{_ATTEMPTS},
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM att),
st AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY run_id ORDER BY step) AS done,
  rn - coalesce(max(CASE WHEN outcome = 'url_changed' THEN rn END) OVER (PARTITION BY run_id ORDER BY step), 0) AS streak FROM n)"""
_LINE = f"""coalesce(nullif(s.operation, ''), 'CLICK') || ' ' || left({_squash("coalesce(s.action, '')")}, 70)
  || CASE WHEN coalesce(s.text, '') <> '' THEN ' = ' || left({_squash("s.text")}, 70) ELSE '' END"""
_INTERACTIVE = "c.tag IN ('a', 'button', 'input', 'textarea', 'select', 'summary')"
_ROLE_OPS = """CASE WHEN tag = 'select' THEN ['SELECT'] WHEN tag = 'textarea' OR (tag = 'input' AND coalesce(kind, 'text') NOT IN ('checkbox', 'radio', 'button', 'submit', 'reset', 'image'))
  THEN ['CLICK', 'TYPE_TEXT'] ELSE ['CLICK'] END"""
_STEPS = f"""
t0 AS (SELECT task_row, unnest(range(len(actions))) AS step, actions FROM tasks),
t1 AS (SELECT task_row, step, actions[step + 1] AS a FROM t0 WHERE actions[step + 1] IS NOT NULL),
t2 AS (SELECT task_row, step, CASE a.operation.op WHEN 'TYPE' THEN 'TYPE_TEXT' ELSE a.operation.op END AS op, coalesce(a.operation.value, '') AS value,
  list_filter(coalesce(a.pos_candidates, []), lambda c: c IS NOT NULL) AS p, list_filter(coalesce(a.neg_candidates, []), lambda c: c IS NOT NULL) AS n FROM t1),
t3 AS (SELECT *, coalesce(list_filter(p, lambda c: coalesce({_INTERACTIVE}, false))[1], p[1]) AS g,
  len(list_distinct(list_transform(list_filter(list_concat(p, n), lambda c: coalesce({_INTERACTIVE}, false)), lambda c: coalesce(c.backend_node_id, '')))) AS pool_size FROM t2),
t4 AS (SELECT *, g.tag AS tag, json_extract_string(g.attributes, '$.type') AS kind FROM t3),
steps_ AS (SELECT task_row, step, op, value, g.backend_node_id AS gold_id, coalesce({_INTERACTIVE.replace("c.tag", "tag")}, false) AS gold_interactive, pool_size,
  CASE WHEN g IS NULL THEN 'no_gold' WHEN NOT coalesce({_INTERACTIVE.replace("c.tag", "tag")}, false) THEN 'gold_not_interactive'
    WHEN NOT coalesce(list_contains({_ROLE_OPS}, op), false) THEN 'op_not_allowed' END AS drop_reason FROM t4)"""
_CASES = """
b AS (SELECT pool_id, unnest(ops) AS op, id, score FROM candidates WHERE score IS NOT NULL AND NOT isnan(score) AND NOT starts_with(pool_id, 'live:')),
top AS (SELECT regexp_extract(pool_id, '^(.*):([0-9]+)$', 1) AS task_id, CAST(regexp_extract(pool_id, '^(.*):([0-9]+)$', 2) AS INT) AS step, op, id
  FROM (SELECT *, row_number() OVER (PARTITION BY pool_id, op ORDER BY score DESC, id) AS rn FROM b) WHERE rn = 1),
has AS (SELECT DISTINCT task_id, step FROM top),
sc AS (SELECT c.*, coalesce(valid_gold AND gold_in_shortlist, false) AS asked, coalesce(has.task_id IS NOT NULL AND gold_op = 'CLICK', false) AS op_ok, coalesce(top.id = gold_id, false) AS element_ok
  FROM step_cases c LEFT JOIN has USING (task_id, step) LEFT JOIN top ON top.task_id = c.task_id AND top.step = c.step AND top.op = c.gold_op)"""
_ELEMENTS = f"""
w AS (SELECT 'live:' || p.page_id AS page, p.page_id AS want_id, h.s.operation AS operation, h.s.action AS target FROM page_snapshots p JOIN h ON p.run_id = h.run_id AND p.step = h.step + 1),
e AS (SELECT pool_id AS page, id, min(label) AS label, list_sort(list_distinct(flatten(list(ops)))) AS ops FROM candidates WHERE starts_with(pool_id, 'live:') GROUP BY 1, 2),
wn AS (SELECT page, want_id, {_norm("coalesce(target, '')")} AS want FROM w WHERE {_norm("coalesce(target, '')")} <> ''),
en AS (SELECT page, id, {_norm("label")} AS name FROM e WHERE label IS NOT NULL),
x AS (SELECT want_id, count(*) AS n, min(id) AS id FROM wn JOIN en ON wn.page = en.page AND want = name GROUP BY 1),
f AS (SELECT want_id, count(*) AS n, min(id) AS id FROM wn JOIN en ON wn.page = en.page AND list_has_all(string_split(name, ' '), string_split(want, ' ')) GROUP BY 1),
res AS (SELECT wn.page, wn.want_id, CASE WHEN x.n = 1 THEN x.id WHEN x.n IS NULL AND f.n = 1 THEN f.id END AS id,
  CASE WHEN x.n = 1 THEN 'resolver' WHEN x.n IS NULL AND f.n = 1 THEN 'resolver_fuzzy' END AS how FROM wn LEFT JOIN x USING (want_id) LEFT JOIN f USING (want_id))"""
_DECISIONS = """
d0 AS (SELECT run_id, success, category, unnest(range(len(decisions))) AS place, decisions FROM live_runs),
d AS (SELECT run_id, success, category, place, decisions[place + 1] AS d FROM d0 WHERE decisions[place + 1] IS NOT NULL)"""
_RATE = "round_even(CAST({a} AS DOUBLE) / nullif({b}, 0), 4)"
_LOGITS = """
z AS (SELECT vec_id, label % 8 + 3 AS n, list_transform(embedding[1:label % 8 + 3], lambda x: CAST(x AS DOUBLE) / 1.2) AS z FROM embeddings),
ez AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)"""

SQL = {
    "attempt_outcomes": f"WITH {_ATTEMPTS} SELECT run_id, CAST(step AS INT) AS step, url, operation, label, outcome, failed, NOT failed AS completed FROM att",
    "exclusions": f"WITH {_EXCLUDED} SELECT * FROM ex",
    "usable_anti": f"WITH {_EXCLUDED} SELECT DISTINCT run_id, url, operation, label FROM att ANTI JOIN ex USING (run_id, url, operation, label)",
    "streak": f"WITH {_STREAK} SELECT run_id, CAST(step AS INT) AS step, streak, done FROM st",
    "blocked_runs": f"""WITH {_HISTORY},
b AS (SELECT run_id, step, count(*) FILTER (s.page_changed = false AND coalesce(s.operation, '') <> 'WAIT') OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM h)
SELECT run_id, CAST(min(step) AS INT) AS first_step FROM b WHERE k = 3 GROUP BY 1""",
    "stalled_runs": f"""WITH {_STREAK},
pl AS (SELECT st.*, count(*) FILTER (NOT failed AND coalesce(trim(h.s.instruction), '') <> '') OVER (PARTITION BY run_id ORDER BY step) AS planned_done FROM st JOIN h USING (run_id, step)),
s4 AS (SELECT *, coalesce(lag(planned_done, 4) OVER (PARTITION BY run_id ORDER BY step), 0) AS before FROM pl)
SELECT run_id, CAST(min(step) AS INT) AS first_step FROM s4 WHERE streak >= 4 AND rn >= 4 AND planned_done = before GROUP BY 1""",
    "step_urls": f"WITH {_HISTORY} SELECT run_id, CAST(step AS INT) AS step, coalesce(lag(s.url_after) OVER (PARTITION BY run_id ORDER BY step), start) AS url_before, s.url_after AS url FROM h",
    "budget_actions": f"WITH {_HISTORY} SELECT run_id, least(count(*), 3) AS n FROM h GROUP BY 1",
    "history_all": f"""WITH {_HISTORY}, l AS (SELECT run_id, step, {_LINE} AS line FROM h)
SELECT run_id, CAST(step AS INT) AS step, line, coalesce(string_agg(line, '|') OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM l""",
    "history_last3": f"""WITH {_HISTORY}, l AS (SELECT run_id, step, {_LINE.replace("coalesce(nullif(s.operation, ''), 'CLICK')", "s.operation")} AS line FROM h)
SELECT run_id, CAST(step AS INT) AS step, coalesce(string_agg(line, '|') OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM l""",
    "parsed_steps": f"WITH {_STEPS} SELECT task_row, CAST(step AS INT) AS step, op, value, gold_id, gold_interactive, CAST(pool_size AS INT) AS pool_size, drop_reason FROM steps_",
    "case_drop_reasons": f"WITH {_STEPS} SELECT op, drop_reason, count(*) AS n, avg(pool_size) AS mean_pool FROM steps_ GROUP BY 1, 2",
    "case_summary": f"""SELECT count(*) AS steps, count(*) FILTER (valid_gold) AS valid_gold, count(*) FILTER (drop_reason IS NULL) AS usable_for_training,
{_RATE.format(a="count(*) FILTER (valid_gold AND gold_in_shortlist)", b="count(*) FILTER (valid_gold)")} AS recall_at_k, median(pool_size) AS median_pool_size FROM step_cases""",
    "micro_metrics": f"""WITH {_CASES} SELECT count(*) AS steps, count(*) FILTER (valid_gold) AS valid_gold, count(*) FILTER (asked) AS scored, CAST(0 AS BIGINT) AS errors,
{_RATE.format(a="count(*) FILTER (asked AND op_ok)", b="count(*) FILTER (asked)")} AS op_acc, {_RATE.format(a="count(*) FILTER (asked AND element_ok)", b="count(*) FILTER (asked)")} AS element_acc_given_op,
{_RATE.format(a="count(*) FILTER (asked AND element_ok)", b="count(*) FILTER (valid_gold)")} AS element_acc_overall,
{_RATE.format(a="count(*) FILTER (asked AND op_ok AND element_ok)", b="count(*) FILTER (asked)")} AS step_success_scored,
{_RATE.format(a="count(*) FILTER (asked AND op_ok AND element_ok)", b="count(*) FILTER (valid_gold)")} AS step_success_overall FROM sc""",
    "macro_metrics": f"""WITH {_CASES},
o AS (SELECT task_id, CASE WHEN drop_reason = 'trivial' THEN true WHEN drop_reason IS NOT NULL THEN false ELSE asked AND element_ok END AS el,
  CASE WHEN drop_reason = 'trivial' THEN true WHEN drop_reason IS NOT NULL THEN false ELSE asked AND op_ok END AS op,
  CASE WHEN drop_reason = 'trivial' THEN true WHEN drop_reason IS NOT NULL THEN false ELSE asked AND op_ok AND element_ok END AS st FROM sc),
t AS (SELECT task_id, avg(CAST(el AS INT)) AS el, avg(CAST(op AS INT)) AS op, avg(CAST(st AS INT)) AS st, CAST(bool_and(st) AS INT) AS ok FROM o GROUP BY 1)
SELECT count(*) AS tasks, round_even(avg(el), 4) AS element_acc_macro, round_even(avg(op), 4) AS op_acc_macro, round_even(avg(st), 4) AS step_success_macro, round_even(avg(ok), 4) AS success_rate FROM t""",
    "resolver_exact_fuzzy": f"WITH {_HISTORY},{_ELEMENTS} SELECT page, want_id, id, how FROM res",
    "router_cascade": f"""WITH {_HISTORY},{_ELEMENTS},{_DECISIONS},
np AS (SELECT page, op AS operation, count(*) AS n FROM (SELECT page, unnest(ops) AS op FROM e) GROUP BY 1, 2),
said AS (SELECT p.page_id AS want_id, d.d.target AS actor, d.d.confidence AS confidence, CASE WHEN d.d.route = 'planner_pick' THEN d.d.target END AS picked
  FROM page_snapshots p JOIN d ON d.run_id = p.run_id AND d.place = p.step - 1),
r AS (SELECT w.want_id, res.id AS resolved, actor, coalesce(confidence, 0.0) AS c, picked, CASE WHEN coalesce(np.n, 0) = 0 THEN 'no_candidates' WHEN how IS NOT NULL THEN how
  WHEN actor IS NOT NULL AND coalesce(confidence, 0) >= 0.5 THEN 'actor' WHEN picked IS NOT NULL THEN 'planner_pick' ELSE 'planner_none' END AS route
  FROM w LEFT JOIN np USING (page, operation) LEFT JOIN res USING (want_id) LEFT JOIN said USING (want_id))
SELECT want_id, route, CASE WHEN starts_with(route, 'resolver') THEN resolved WHEN route = 'actor' THEN actor WHEN route = 'planner_pick' THEN picked END AS id,
  CASE WHEN route = 'no_candidates' THEN 0.0 WHEN starts_with(route, 'resolver') THEN 1.0 ELSE c END AS confidence FROM r""",
    "choice_validation": f"""WITH {_DECISIONS} SELECT run_id, CAST(place AS INT) AS place,
  coalesce(d.choice IS NOT NULL AND d.choice <> 'other' AND NOT isnan(d.confidence) AND d.confidence BETWEEN 0 AND 1 AND d.confidence >= 1 - d.confidence - 1e-6, false) AS valid FROM d""",
    "text_validation": f"""WITH {_HISTORY} SELECT s.operation AS operation, count(*) AS n,
  count(*) FILTER (regexp_matches(s.text, '\\S') AND length(s.text) <= 2000 AND lower(trim(s.text)) NOT IN ('false', 'true', 'null', 'none')) AS valid FROM h GROUP BY 1""",
    "plan_validation": f"""WITH {_HISTORY},
p AS (SELECT run_id, step, s.operation AS op, trim(coalesce(s.action, '')) AS t, trim(coalesce(s.text, '')) AS v, trim(coalesce(s.instruction, '')) AS i FROM h),
q AS (SELECT *, op IN ('TYPE_TEXT', 'SELECT') AS val FROM p),
r AS (SELECT *, coalesce(val AND v = '' AND t <> '', false) AS swap FROM q),
u AS (SELECT *, CASE WHEN swap THEN '' ELSE t END AS target, CASE WHEN swap THEN t ELSE v END AS value FROM r)
SELECT run_id, CAST(step AS INT) AS step, target, value, array_to_string(string_split({_squash("i")}, ' ')[1:20], ' ') AS instruction,
  CASE WHEN op IS NULL OR op NOT IN ('CLICK', 'TYPE_TEXT', 'SELECT', 'SCROLL_TO_TEXT', 'GOTO') THEN 'unknown operation' WHEN NOT val AND target = '' THEN 'no target'
    WHEN val AND value = '' THEN 'no value' WHEN val AND lower(value) IN ('false', 'true', 'null', 'none') THEN 'literal value' WHEN op = 'GOTO' THEN 'address not allowed'
    WHEN i = '' THEN 'no instruction' END AS error FROM u""",
    "json_extract": r"""WITH j AS (SELECT doc_id, regexp_extract(text, '(?s)(\{.*\})', 1) AS b FROM documents WHERE contains(text, '{'))
SELECT doc_id, CASE WHEN json_valid(b) THEN json_type(b) = 'OBJECT' ELSE false END AS is_object FROM j""",
    "url_canonical": r"""SELECT doc_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical,
  regexp_replace(url, '(?s)#.*$', '') AS page, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM documents WHERE url IS NOT NULL""",
    "evidence_shown": f"""WITH q AS (SELECT run_id, {_norm("coalesce(string_split(final_title, ' | ')[1], '')")} AS q, {_norm("coalesce(final_text, '')")} AS t FROM live_runs)
SELECT run_id, q <> '' AND contains(t, q) AS shown FROM q""",
    "char_budget": """WITH r AS (SELECT pool_id, cand_row, label, row_number() OVER (PARTITION BY pool_id ORDER BY cand_row) AS rn FROM candidates WHERE label IS NOT NULL),
s AS (SELECT *, sum(length(label)) OVER (PARTITION BY pool_id ORDER BY cand_row) AS run FROM r WHERE rn <= 25)
SELECT pool_id, count(*) AS kept, CAST(sum(length(label)) AS BIGINT) AS chars FROM s WHERE rn = 1 OR run <= 400 GROUP BY 1""",
    "run_summary": """WITH d AS (SELECT unnest(decisions) AS d FROM live_runs), p AS (SELECT unnest(planner_calls) AS p FROM live_runs)
SELECT count(*) FILTER (success) AS passed, count(*) AS n, (SELECT median(d.latency_ms) FROM d) AS median_decision_ms, (SELECT median(d.actor_ms) FROM d WHERE d.actor_ms > 0) AS median_actor_ms,
  (SELECT median(p.latency_ms) FROM p) AS median_planner_ms, (SELECT count(p.error) FROM p) AS planner_errors, round_even(sum(coalesce(seconds, 0)) / nullif(sum(len(steps)), 0), 2) AS wall_s_per_action FROM live_runs""",
    "category_summary": "SELECT coalesce(category, '') AS category, count(*) FILTER (success) AS passed, count(*) AS n FROM live_runs GROUP BY 1",
    "route_histogram": f"WITH {_DECISIONS} SELECT category, coalesce(nullif(d.route, ''), 'none') AS route, count(*) AS n FROM d GROUP BY 1, 2",
    "nearest_rank_p90": f"""WITH {_DECISIONS},
o AS (SELECT d.operation AS operation, list(d.latency_ms ORDER BY d.latency_ms) AS v FROM d WHERE d.operation IS NOT NULL AND d.latency_ms IS NOT NULL GROUP BY 1)
SELECT operation, len(v) AS n, (v[CAST(floor((len(v) - 1) / 2) AS INT) + 1] + v[CAST(ceil((len(v) - 1) / 2) AS INT) + 1]) / 2 AS median, v[CAST(floor(0.5 * (len(v) - 1)) AS INT) + 1] AS p50,
  v[CAST(floor(0.9 * (len(v) - 1)) AS INT) + 1] AS p90, v[CAST(floor(0.99 * (len(v) - 1)) AS INT) + 1] AS p99 FROM o""",
    "majority_vote": """SELECT website, category, count(*) AS runs, count(*) FILTER (success) AS passed, count(*) FILTER (success) * 2 > count(*) AS majority
FROM live_runs WHERE website IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2""",
    "mcnemar": """WITH m AS (SELECT website, run_id % 2 AS k, count(*) FILTER (success) * 2 > count(*) AS ok FROM live_runs WHERE website IS NOT NULL GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (a.ok AND b.ok) AS both, count(*) FILTER (a.ok AND NOT b.ok) AS only_left, count(*) FILTER (NOT a.ok AND b.ok) AS only_right, count(*) FILTER (NOT a.ok AND NOT b.ok) AS neither
  FROM m a JOIN m b USING (website) WHERE a.k = 1 AND b.k = 0)
SELECT *, CASE WHEN only_left + only_right = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(only_left, only_right) + 1),
  lambda i: exp(lgamma(only_left + only_right + 1) - lgamma(i + 1) - lgamma(only_left + only_right - i + 1) - (only_left + only_right) * ln(2))))), 6) END AS p FROM c""",
    "threshold_fit": f"""WITH {_DECISIONS},
t AS (SELECT d.confidence AS c, count(*) AS n, count(*) FILTER (success) AS k FROM d WHERE d.confidence IS NOT NULL GROUP BY 1),
r AS (SELECT c, sum(k) OVER (ORDER BY c DESC) / sum(n) OVER (ORDER BY c DESC) AS acc FROM t)
SELECT coalesce(min(c), 1.01) AS threshold FROM r WHERE acc >= 0.62""",
    "frequent_actions": f"WITH {_HISTORY} SELECT s.action AS action, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, action NULLS LAST LIMIT 8",
    "dev_split": "SELECT website, CAST(('0x' || md5(website))::uhugeint % 20 AS INT) AS bucket, (('0x' || md5(website))::uhugeint % 20) = 0 AS dev FROM sites",
    "task_sample": """SELECT case_id, task_id FROM step_cases WHERE task_id IN (SELECT task_id FROM (SELECT DISTINCT task_id FROM step_cases WHERE task_id IS NOT NULL) ORDER BY md5(task_id || ':0'), task_id LIMIT 25)""",
    "row_sample": "SELECT case_id, step FROM step_cases ORDER BY md5(case_id || ':0'), case_id LIMIT 40",
    "stride_sample": """SELECT case_id, step FROM (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM step_cases) WHERE i % greatest(1, CAST(ceil(n / 100) AS INT)) = 0""",
    "rank_shards": "SELECT case_id, step FROM (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM step_cases) WHERE i < n - n % 4 AND i % 4 = 1",
    "softmax_temperature": f"WITH {_LOGITS} SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top, round(e[1] / list_sum(e), 9) AS first FROM ez",
    "item_targets": "SELECT vec_id, CAST(label % (label % 8 + 3) AS INT) AS label, 1.0 AS mass FROM embeddings",
    "padded_batches": """WITH p AS (SELECT label % 8 + 3 AS n, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 16) AS BIGINT) AS batch FROM embeddings)
SELECT batch, count(*) AS n, CAST(max(n) AS INT) AS length, CAST(sum(p.n) AS BIGINT) AS real FROM p GROUP BY batch""",
    "asof_frame": """WITH v AS (SELECT ts, user_id, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view'), p AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, view_id, view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
}
