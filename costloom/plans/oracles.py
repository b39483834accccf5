"""DuckDB SQL for the registered queries. Common table expressions are shared as text."""

from __future__ import annotations

from costloom.functions import dims
from costloom.operators import scope, smoothing
from costloom.plans.views import MODEL_ROWS


def _values(rows) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


PERIOD = ("2024-01-05T18:00:00", "2024-01-12T06:30:00")  # of usage_period
SUFFIX = r"-\d{4}(-\d{2}-\d{2}|\d{4})?$"


def provider(m: str) -> str:
    starts = lambda *p: " OR ".join(f"starts_with(lower({m}), '{x}')" for x in p)
    rows = [("mistral", "mistral", "codestral", "open-mistral"), ("deepseek", "deepseek"), ("xai", "grok"), ("meta", "llama"), ("cohere", "command")]
    rest = " ".join(f"WHEN {starts(*p)} THEN '{name}'" for name, *p in [("anthropic", "claude"), ("google", "gemini"), *rows])
    return f"CASE WHEN contains(lower({m}), 'text-embedding-004') THEN 'google' WHEN {starts('gpt-', 'o1', 'o3')} OR contains(lower({m}), 'text-embedding') THEN 'openai' {rest} ELSE 'unknown' END"


PRICES = f"""prices AS (SELECT * FROM {_values(dims.PRICE_ROWS)} t(price_model, pin, pout)),
tiers AS (SELECT * FROM {_values(dims.TIER_ROWS)} t(tier, tier_model, ordinal))"""


def tier(m: str) -> str:
    return f"coalesce((SELECT any_value(tier) FROM tiers WHERE tier_model = {m}), (SELECT any_value(tier) FROM tiers WHERE tier_model = regexp_replace({m}, '{SUFFIX}', '')), 'Unknown')"


def resolved(source: str) -> str:
    return f"""parts_of AS (SELECT DISTINCT model, string_split(regexp_replace(model, '{SUFFIX}', ''), '-') AS parts FROM {source}),
cands AS (SELECT model, 0 AS pos, model AS c FROM parts_of UNION ALL
  SELECT model, len(parts) - k + 1, array_to_string(parts[1:k], '-') FROM parts_of, unnest(generate_series(1, len(parts))) g(k)),
resolved AS (SELECT model, arg_min(price_model, pos) AS priced_as, arg_min(pin, pos) AS input, arg_min(pout, pos) AS output
  FROM cands JOIN prices ON c = price_model GROUP BY model)"""


USES = f"""uses AS (SELECT * FROM {_values(MODEL_ROWS)} t(event_type, k3, model, in_unit, out_unit))"""
CALLS = f"""{PRICES}, {USES}, calls AS (SELECT event_id AS id, user_id % 5 + 1 AS project_id, user_id, ts AS "timestamp", model,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * in_unit AS tokens_in, CAST(floor(value * out_unit) AS BIGINT) AS tokens_out
  FROM events e LEFT JOIN uses u ON e.event_type = u.event_type AND event_id % 3 = k3)"""
COST = "tokens_in / 1e6 * coalesce(input, 5.0::DOUBLE) + tokens_out / 1e6 * coalesce(output, 15.0::DOUBLE)"
USAGE = f"""WITH {CALLS}, {resolved("calls")}, usage AS MATERIALIZED (
  SELECT c.*, {COST} AS cost_usd, {provider("c.model")} AS provider FROM calls c LEFT JOIN resolved USING (model))"""
DAILY = 'SELECT project_id, CAST("timestamp" AS DATE) AS day, sum(cost_usd) AS cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens FROM {} GROUP BY ALL'
PROFILE = """profile AS (SELECT project_id, model, count(*) AS calls, sum(cost_usd) AS total_cost, avg(tokens_in) AS avg_in, avg(tokens_out) AS avg_out,
  count(*) FILTER (tokens_out < 200) AS short_calls, coalesce(sum(cost_usd) FILTER (tokens_out < 200), 0) AS short_cost FROM usage GROUP BY ALL)"""
TASK = "CASE WHEN avg_in > 20000 OR avg_out > 800 THEN 'Heavy' WHEN avg_in < 5000 AND avg_out < 200 THEN 'Light' ELSE 'Standard' END"


def bucket(ts: str, k) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:') || lpad(CAST((minute({ts}) // {k}) * {k} AS VARCHAR), 2, '0')"


USERS = USAGE + """, uu0 AS (SELECT *, CASE WHEN day("timestamp") % 7 = 0 THEN 0.0::DOUBLE ELSE cost_usd END AS c FROM usage),
uu AS MATERIALIZED (SELECT id, user_id AS project_id, "timestamp", model, tokens_in, tokens_out, c AS cost_usd FROM uu0 UNION ALL
  SELECT id, user_id + 1000000, date_trunc('day', "timestamp"), model, tokens_in, tokens_out, c FROM uu0)"""


def projects_of(source: str) -> str:
    return f"""spends AS (SELECT project_id, sum(cost_usd) AS spend FROM {source} GROUP BY ALL),
proj0 AS (SELECT project_id, 'project-' || project_id AS name, '/srv/' || project_id AS path,
  spend / 25 * ([0.3, 1.0, 4.0]::DOUBLE[])[project_id % 3 + 1] AS baseline_daily_cost, CAST(26 + project_id % 4 * 5 AS INTEGER) AS baseline_total_days FROM spends),
proj AS MATERIALIZED (SELECT *, baseline_daily_cost * baseline_total_days AS baseline_total_cost,
  CASE WHEN project_id % 5 <> 0 THEN baseline_daily_cost * baseline_total_days * (project_id % 5) / 2 END AS budget FROM proj0)"""


HISTORY = """weeks AS (SELECT project_id, date_trunc('week', "timestamp") AS week, sum(cost_usd) AS cost FROM uu GROUP BY ALL),
hist0 AS (SELECT project_id, CAST(row_number() OVER w AS INTEGER) AS iteration, sum(cost) OVER w AS run FROM weeks WINDOW w AS (PARTITION BY project_id ORDER BY week)),
hist AS (SELECT project_id, iteration, run / iteration * 4.2857143::DOUBLE AS projected_total FROM hist0)"""
UP = USERS + ", " + projects_of("uu")

SERIES = f"""daily AS ({DAILY.format("uu")}),
mins AS (SELECT project_id, date_trunc('minute', "timestamp") AS mn, sum(cost_usd) AS cost, sum(tokens_in + tokens_out) AS total_tokens FROM uu GROUP BY ALL),
sized AS (SELECT project_id, k AS minutes, {bucket("mn", "k")} AS bucket, sum(cost) AS cost, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM mins, (VALUES (15), (5), (1)) s(k) GROUP BY ALL),
enough AS (SELECT project_id, minutes, count(*) FILTER (cost > 0) AS n FROM sized GROUP BY ALL),
picked AS (SELECT project_id, coalesce(max(minutes) FILTER (n >= 3), 1) AS minutes FROM enough GROUP BY ALL),
adaptive AS (SELECT sized.* FROM sized JOIN picked USING (project_id, minutes)),
lists AS (SELECT p.*, coalesce(dt.total_tokens, 0) AS total_tokens, coalesce(d.l, []) AS daily, coalesce(d.spend, 0) AS actual_spend, coalesce(b.l, []) AS buckets, b.minutes
  FROM proj p LEFT JOIN (SELECT project_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM daily GROUP BY ALL) dt USING (project_id)
  LEFT JOIN (SELECT project_id, list(cost ORDER BY day) AS l, sum(cost) AS spend FROM daily WHERE cost > 0 GROUP BY ALL) d USING (project_id)
  LEFT JOIN (SELECT project_id, list(cost ORDER BY bucket) AS l, max(minutes) AS minutes FROM adaptive WHERE cost > 0 GROUP BY ALL) b USING (project_id)),
used AS (SELECT *, len(daily) AS active_days, len(buckets) >= 3 AND len(buckets) > len(daily) AS use_buckets FROM lists),
choice AS MATERIALIZED (SELECT * EXCLUDE (buckets, minutes), CASE WHEN use_buckets THEN buckets ELSE daily END AS series, CASE WHEN use_buckets THEN len(buckets) ELSE len(daily) END AS n,
  greatest(1, baseline_total_days - len(daily)) AS remaining_days, CASE WHEN use_buckets THEN len(buckets)::DOUBLE / greatest(1, len(daily)) ELSE 1.0 END AS buckets_per_day,
  CASE WHEN use_buckets THEN len(buckets) ELSE greatest(1, baseline_total_days - len(daily)) END AS horizon,
  CASE WHEN use_buckets THEN minutes || 'min_buckets' ELSE 'daily' END AS data_granularity, CASE WHEN baseline_daily_cost > 0 THEN baseline_daily_cost ELSE 1.0 END AS base FROM used)"""
FOLD = """list_reduce(series, lambda s, c: {'a': (1 - alpha) * s.a + alpha * c, 'w': (1 - alpha) * s.w, 'dd': s.dd + (c - s.a) * (c - s.a),
  'dw': s.dw + (c - s.a) * s.w, 'ww': s.ww + s.w * s.w}, {'a': 0.0::DOUBLE, 'w': 1.0::DOUBLE, 'dd': 0.0::DOUBLE, 'dw': 0.0::DOUBLE, 'ww': 0.0::DOUBLE})"""
ERRORS = """list_reduce(series, lambda s, c: {'level': s.level + alpha * (c - s.level), 'sq': s.sq + (c - s.level) * (c - s.level), 'ab': s.ab + abs(c - s.level)},
  {'level': level0, 'sq': 0.0::DOUBLE, 'ab': 0.0::DOUBLE})"""
LINE = """xy AS (SELECT project_id, n, c, i - 1 AS x FROM choice, unnest(series) WITH ORDINALITY AS u(c, i)),
regr AS (SELECT project_id, regr_slope(c, x) AS slope, regr_intercept(c, x) AS intercept FROM xy GROUP BY project_id)"""


def grid(name: str, source: str) -> str:
    """Best alpha of a table with project_id, series, alpha."""
    return f"""{name}_f AS MATERIALIZED (SELECT project_id, alpha, {FOLD} AS s FROM {source}),
{name} AS (SELECT project_id, arg_min(alpha, k) AS alpha, arg_min(l0, k) AS level0 FROM (
  SELECT project_id, alpha, s.dw / s.ww AS l0, (round(s.dd - s.dw * s.dw / s.ww, 9), alpha) AS k FROM {name}_f) GROUP BY project_id)"""


SES = f"""{LINE}, {grid("coarse", "(SELECT project_id, series, a / 100.0::DOUBLE AS alpha FROM choice, generate_series(1, 99) g(a) WHERE n >= 10)")},
near AS (SELECT c.project_id, c.series, round(k.alpha + j / 1000.0::DOUBLE, 3) AS alpha FROM choice c JOIN coarse k USING (project_id), generate_series(-10, 10) g(j)),
{grid("fine", "(SELECT * FROM near WHERE alpha > 0 AND alpha < 1)")},
start AS (SELECT project_id, series, alpha, level0 FROM choice JOIN fine USING (project_id) WHERE n >= 10),
ses_o AS (SELECT project_id, alpha, level0, {ERRORS} AS e FROM start),
start_f AS (SELECT project_id, n, series, 0.3::DOUBLE AS alpha, intercept - slope AS level0 FROM choice JOIN regr USING (project_id) WHERE n >= 2),
ses_x AS (SELECT project_id, n, alpha, level0, {ERRORS} AS e FROM start_f),
ses AS MATERIALIZED (SELECT project_id, e.level AS ses_level, e.sq AS sse, e.ab AS sae FROM ses_o UNION ALL SELECT project_id, e.level, e.sq, e.ab FROM ses_x WHERE n < 10)"""
_e = ["c - s.l0 - phi * s.b0", "-s.l1 - phi * s.b1", "-s.l2 - phi * s.b2"]
_pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_state = ", ".join([f"'l{i}': s.l{i} + phi * s.b{i} + alpha * ({_e[i]})" for i in range(3)] + [f"'b{i}': phi * s.b{i} + beta * ({_e[i]})" for i in range(3)] + [f"'s{i}{j}': s.s{i}{j} + ({_e[i]}) * ({_e[j]})" for i, j in _pairs])
_zero = ", ".join(f"'{k}': {v}::DOUBLE" for k, v in [("l0", 0.0), ("l1", 1.0), ("l2", 0.0), ("b0", 0.0), ("b1", 0.0), ("b2", 1.0)] + [(f"s{i}{j}", 0.0) for i, j in _pairs])
_order = "round(sse, 6), alpha, share, phi"


def trend_runs(name: str, points: str) -> str:
    """Squared error and end of each of the points (project_id, start, series, alpha, share, phi)."""
    return f"""{name}_r AS (SELECT * EXCLUDE (series), list_reduce(series, lambda s, c: {{{_state}}}, {{{_zero}}}) AS s FROM (SELECT *, alpha * share AS beta FROM {points})),
{name}_d AS (SELECT *, s.s11 * s.s22 - s.s12 * s.s12 AS det FROM {name}_r),
{name}_s AS (SELECT *, CASE WHEN abs(det) > 1e-12 THEN (-s.s01 * s.s22 + s.s02 * s.s12) / det ELSE 0 END AS x, CASE WHEN abs(det) > 1e-12 THEN (-s.s02 * s.s11 + s.s01 * s.s12) / det ELSE 0 END AS y FROM {name}_d),
{name} AS MATERIALIZED (SELECT project_id, start, alpha, beta, share, phi, s.l0 + x * s.l1 + y * s.l2 AS level, s.b0 + x * s.b1 + y * s.b2 AS trend,
  s.s00 + 2 * x * s.s01 + 2 * y * s.s02 + x * x * s.s11 + 2 * x * y * s.s12 + y * y * s.s22 AS sse FROM {name}_s
  QUALIFY row_number() OVER (PARTITION BY project_id, start ORDER BY {_order}) = 1)"""


def trend_turn(k: int) -> str:
    """A turn of the fine stage: the cube around each start's best point."""
    within = ", ".join(f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, t.{c} + m.{c})) AS {c}" for c, lo, hi in zip(("alpha", "share", "phi"), map(float, smoothing.TREND_LEAST), map(float, smoothing.TREND_MOST)))
    moves = _values([tuple(map(float, r)) for r in smoothing.trend_moves(k)])
    return trend_runs(f"turn{k + 1}", f"(SELECT project_id, start, series, {within} FROM turn{k} t JOIN choice USING (project_id), {moves} m(alpha, share, phi))")


DAMPED = f"""{trend_runs("turn0", f"(SELECT project_id, share AS start, series, alpha, share, phi FROM choice, {_values([tuple(map(float, r)) for r in smoothing.trend_grid()])} t(alpha, share, phi) WHERE n >= 10)")},
{", ".join(map(trend_turn, range(smoothing.TREND_TURNS)))},
damped AS MATERIALIZED (SELECT project_id, phi, level, trend, sse, alpha, beta FROM turn{smoothing.TREND_TURNS} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_order}) = 1)"""
EMA = "list_reduce(daily, lambda s, c: least(0.6, 0.15 + 0.03 * active_days) * c / base + (1 - least(0.6, 0.15 + 0.03 * active_days)) * s, 1.0::DOUBLE)"
STEP = """(CASE WHEN ses_level IS NULL THEN 0 ELSE greatest(0, ses_level) END + CASE WHEN phi IS NULL THEN 0 ELSE greatest(0, level + trend * phi * (1 - pow(phi, h)) / (1 - phi)) END
  + CASE WHEN n < 3 THEN 0 ELSE greatest(0, intercept + slope * (n + h - 1)) END) / m"""
CORE = f"""{SES}, {DAMPED},
mem AS (SELECT c.*, ses_level, s.sse, s.sae, d.phi, d.level, d.trend, slope, intercept, (ses_level IS NOT NULL)::INT + (d.phi IS NOT NULL)::INT + (n >= 3)::INT AS m,
  concat_ws(',', CASE WHEN ses_level IS NOT NULL THEN 'ses' END, CASE WHEN d.phi IS NOT NULL THEN 'damped_trend' END, CASE WHEN n >= 3 THEN 'linear' END) AS names, {EMA} AS ema_ratio
  FROM choice c LEFT JOIN ses s USING (project_id) LEFT JOIN damped d USING (project_id) LEFT JOIN regr USING (project_id)),
stepped AS (SELECT *, CASE WHEN m > 0 THEN list_transform(generate_series(1, horizon), lambda h: {STEP})
  ELSE list_transform(generate_series(1, remaining_days), lambda h: greatest(0, ema_ratio * base)) END AS steps, CASE WHEN m > 0 THEN names ELSE 'ema_fallback' END AS models_used FROM mem),
remain AS (SELECT *, CASE WHEN m > 0 AND use_buckets THEN list_sum(steps) / len(steps) * buckets_per_day * remaining_days ELSE list_sum(steps) END AS projected_remaining FROM stepped),
tot AS (SELECT *, CASE WHEN m > 0 THEN projected_remaining / remaining_days / base ELSE ema_ratio END AS smoothed_burn_ratio, actual_spend + projected_remaining AS projected_total,
  projected_remaining / remaining_days AS dm, sqrt(sse / n) * CASE WHEN use_buckets THEN sqrt(buckets_per_day) ELSE 1 END AS sg, n >= 2 AND sse > 0 AS known FROM remain),
core AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN known THEN actual_spend + list_sum(list_transform(generate_series(1, remaining_days), lambda h: {f % f'dm {sign} {z} * sg * sqrt(h)'})) END AS pi{name}_{side}" for name, z in (("80", 1.28), ("95", 1.96)) for side, sign, f in (("lower", "-", "greatest(0, %s)"), ("upper", "+", "%s")))},
  list_sum(list_transform(generate_series(2, n), lambda i: abs(series[i] - series[i - 1]))) / (n - 1) AS naive FROM tot),
tail AS (SELECT project_id, v / base AS r, len(daily) - o AS back FROM core, unnest(daily) WITH ORDINALITY AS u(v, o) WHERE len(daily) - o < 5),
runs_of AS (SELECT project_id, coalesce(min(back) FILTER (r <= 1.5), count(*)) AS over_run, coalesce(min(back) FILTER (r >= 0.5), count(*)) AS under_run FROM tail GROUP BY ALL),
fin AS MATERIALIZED (SELECT core.*, CASE WHEN smoothed_burn_ratio > 1.5 AND over_run >= 3 THEN 'over_budget' WHEN smoothed_burn_ratio < 0.5 AND under_run >= 3 THEN 'under_budget' ELSE 'on_track' END AS drift_status,
  CASE WHEN active_days = 0 THEN 'low' WHEN active_days <= 3 THEN 'medium-low' WHEN active_days <= 7 THEN 'medium' WHEN active_days <= 14 THEN 'high' ELSE 'very-high' END AS confidence,
  CASE WHEN n >= 3 AND naive > 0 THEN sae / n / naive END AS mase, CASE WHEN n >= 2 THEN sae / n * remaining_days END AS mae_dollars FROM core LEFT JOIN runs_of USING (project_id))"""
STABLE = f"""{HISTORY}, lastruns AS (SELECT project_id, iteration, projected_total AS total FROM hist QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY iteration DESC) <= 4),
both_ AS (SELECT * FROM lastruns UNION ALL SELECT project_id, 2147483647, projected_total FROM fin),
chg AS (SELECT project_id, abs(total - lag(total) OVER w) / greatest(total, 0.001) * 100 AS change FROM both_ WINDOW w AS (PARTITION BY project_id ORDER BY iteration)),
stab0 AS (SELECT project_id, avg(change) AS stability FROM chg GROUP BY ALL),
stab AS (SELECT f.project_id, stability, CASE WHEN stability < 5 THEN 'converged' WHEN stability <= 15 THEN 'stabilizing' WHEN stability IS NOT NULL THEN 'adjusting' END AS stability_label,
  CAST(coalesce(k, 0) + 1 AS INTEGER) AS iteration FROM fin f LEFT JOIN stab0 USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS k FROM hist GROUP BY ALL) USING (project_id))"""
CHOICE = f"{UP}, {SERIES}"
FULL = f"{CHOICE}, {CORE}"
SHARES = """mc AS (SELECT project_id, model, sum(cost_usd) AS spent FROM uu GROUP BY ALL),
shares AS (SELECT project_id, model, spent, spent / actual_spend AS share, spent + spent / actual_spend * projected_remaining AS projected FROM mc JOIN fin USING (project_id) WHERE actual_spend > 0)"""
RECORD = f"{FULL}, {STABLE}, {SHARES}"

SKIP = "starts_with(ct, 'text/event-stream')"
RAW = f"""WITH {CALLS}, typed AS (SELECT id % 13 AS k, id % 17 AS p17, project_id AS pid, "timestamp" AS ts, model AS m, tokens_in AS i, tokens_out AS o FROM calls),
raw AS (SELECT CASE WHEN p17 <> 0 THEN pid END AS project_id, ts AS "timestamp", CASE WHEN k = 12 THEN 'text/event-stream; charset=utf-8' ELSE 'application/json' END AS ct,
  CASE WHEN k < 3 THEN '{{"model":"' || m || '","usage":{{"prompt_tokens":' || i || ',"completion_tokens":' || o || '}}}}'
  WHEN k = 3 THEN '{{"model":"' || m || '","usage":{{"input_tokens":' || i || ',"output_tokens":' || o || '}}}}'
  WHEN k = 4 THEN '{{"id":"' || m || '","model":7,"usage":{{"prompt_tokens":' || i || ',"completion_tokens":' || o || '}}}}'
  WHEN k = 5 THEN '{{"choices":[{{"x":1}},{{"message":{{"model":"' || m || '"}}}}],"usage":{{"prompt_tokens":' || i || ',"completion_tokens":' || o || '}}}}'
  WHEN k = 6 THEN '{{"error":{{"code":' || i || '}}}}' WHEN k = 7 THEN ''
  WHEN k = 8 THEN '{{"model":"' || m || '","usage":{{"prompt_tokens":"many","completion_tokens":' || o || '}}}}'
  WHEN k = 9 THEN '[' || i || ',' || o || ']' WHEN k = 10 THEN '{{"model":"' || m || '",'
  WHEN k = 11 THEN '{{"usage":{{"prompt_tokens":' || i || ',"output_tokens":' || o || '}}}}'
  ELSE '{{"model":"' || m || '","usage":{{"prompt_tokens":' || i || ',"completion_tokens":' || o || '}}}}' END AS body FROM typed),
js AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body END AS j FROM raw),
fields AS (SELECT *, json_type(j) AS root, json_type(j, '$.usage') AS ut, json_extract_string(j, '$.usage.prompt_tokens') AS a1, json_extract_string(j, '$.usage.completion_tokens') AS a2,
  json_extract_string(j, '$.usage.input_tokens') AS b1, json_extract_string(j, '$.usage.output_tokens') AS b2,
  coalesce(CASE WHEN json_type(j, '$.model') = 'VARCHAR' THEN json_extract_string(j, '$.model') END, CASE WHEN json_type(j, '$.id') = 'VARCHAR' THEN json_extract_string(j, '$.id') END,
    list_filter(json_extract_string(j, '$.choices[*].message.model'), lambda x: x IS NOT NULL)[1], 'unknown') AS model FROM js),
toks AS (SELECT *, TRY_CAST(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a1 WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN b1 END AS BIGINT) AS tokens_in,
  TRY_CAST(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a2 WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN b2 END AS BIGINT) AS tokens_out FROM fields),
stat AS (SELECT *, CASE WHEN {SKIP} THEN 'skipped_streaming' WHEN j IS NULL THEN 'ignored' WHEN root <> 'OBJECT' THEN 'error'
  WHEN ut IS NULL OR ut <> 'OBJECT' OR NOT ((a1 IS NOT NULL AND a2 IS NOT NULL) OR (b1 IS NOT NULL AND b2 IS NOT NULL)) THEN 'ignored'
  WHEN tokens_in IS NULL OR tokens_out IS NULL THEN 'error' WHEN project_id IS NULL THEN 'ignored' ELSE 'tracked' END AS status FROM toks)"""
_LENIENT = """, lenient AS (SELECT project_id, "timestamp", coalesce(json_extract_string(j, '$.model'), json_extract_string(j, '$.id'), 'unknown') AS model,
  TRY_CAST(coalesce(a1, b1, '0') AS BIGINT) AS tokens_in, TRY_CAST(coalesce(a2, b2, '0') AS BIGINT) AS tokens_out FROM fields WHERE root = 'OBJECT' AND ut = 'OBJECT' AND project_id IS NOT NULL)"""


def priced(source: str) -> str:
    return f"SELECT project_id, \"timestamp\", t.model, {provider('t.model')} AS provider, tokens_in, tokens_out, round({COST}, 6) AS cost_usd, 'api' AS source FROM {source} t LEFT JOIN resolved USING (model)"


_like = lambda col, words: " OR ".join(f"contains({col}, '{w}')" for w in words)
_q = lambda s: s.replace("'", "''")
FILES = f"""WITH src AS (SELECT doc_id % 40 + 1 AS project_id, doc_id // 40 AS k, text FROM documents),
files AS (SELECT project_id, CASE WHEN k = 0 THEN 'README.md' WHEN k = 1 AND project_id % 3 = 0 THEN 'package.json' WHEN k % 7 = 2 THEN 'web/app' || k || '.ts' WHEN k % 7 = 3 THEN 'node_modules/m' || k || '.js'
  WHEN k % 7 = 4 THEN 'a/b/c/d/e/f/g' || k || '.py' WHEN k % 7 = 5 THEN '.cache/x' || k || '.tar.gz' WHEN k % 7 = 6 THEN 'docs/Note' || k ELSE 'src/mod' || k || '.py' END AS path,
  CASE WHEN k = 0 THEN ['A chatbot. ', 'RAG system for retrieval. ', 'Disk storage. ', 'Notes. '][project_id % 4 + 1]
  WHEN k % 3 = 0 THEN CASE WHEN project_id % 2 = 0 THEN 'import anthropic' || chr(10) ELSE 'import  openai' || chr(10) END ELSE '' END || coalesce(text, '') AS content FROM src),
parts AS (SELECT *, string_split(path, '/') AS p FROM files),
seen AS (SELECT *, len(p) > {scope.DEPTH} OR len(list_filter(p, lambda x: x IN ({", ".join(f"'{x}'" for x in scope.SKIPPED)}) OR starts_with(x, '.'))) > 0 AS ignored FROM parts),
exts AS (SELECT project_id, CASE WHEN regexp_extract(p[-1], '.(\\.[^.]+)$', 1) = '' THEN '(no ext)' ELSE regexp_extract(p[-1], '.(\\.[^.]+)$', 1) END AS ext FROM seen WHERE NOT ignored UNION ALL
  SELECT DISTINCT project_id, path FROM files WHERE path IN ({", ".join(f"'{x}'" for x in scope.MANIFESTS)})),
counts AS (SELECT project_id, ext, count(*) AS files FROM exts GROUP BY ALL)"""
_readme = "CASE path " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(scope.README)) + " END"
_ext = "CASE regexp_extract(path, '(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(scope.EXTENSIONS)) + " END"
_hit = " OR ".join(f"regexp_matches(head, '{_q(p)}')" for p in scope.SDK["anthropic"])


def _parameters() -> str:
    cost = lambda m, i, o: f"({i} / 1e6 * (SELECT pin FROM prices WHERE price_model = '{m}') + {o} / 1e6 * (SELECT pout FROM prices WHERE price_model = '{m}'))"
    rows = []
    for a, large, little in (("false", "gpt-4o", "gpt-4o-mini"), ("true", "claude-3-5-sonnet-latest", "claude-3-5-haiku-latest")):
        rows.append(f"SELECT 'agent' AS project_type, {a} AS anthropic, '{large}' AS model, 80 AS calls_per_day, 2000 AS tokens_in, 1500 AS tokens_out, 80 * {cost(large, 2000, 1500)} AS daily")
        rows.append(f"SELECT 'rag', {a}, '{large}', 125, 3000, 1000, 100 * {cost('text-embedding-3-small', 1500, 0)} + 25 * {cost(large, 3000, 1000)}")
        rows.append(f"SELECT 'default', {a}, '{little}', 50, 600, 1000, 50 * {cost(little, 600, 1000)}")
    return " UNION ALL ".join(rows)


BASELINE = f"""{FILES}, {PRICES}, readme AS (SELECT project_id, lower(left(arg_min(content, {_readme}), {scope.README_CHARS})) AS readme FROM files WHERE {_readme} IS NOT NULL GROUP BY ALL),
code AS (SELECT *, {_ext} AS kind FROM seen WHERE {_ext} IS NOT NULL), capped AS (SELECT * FROM code QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY path) <= {scope.PER_EXTENSION}),
capped2 AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY kind, path) <= {scope.OVERALL}),
heads AS (SELECT project_id, array_to_string(regexp_split_to_array(content, '{scope.LINE_BREAK_RE2}')[1:{scope.LINES}], chr(10)) AS head FROM capped2 WHERE NOT ignored),
sdk AS (SELECT project_id, bool_or({_hit}) AS anthropic FROM heads GROUP BY ALL),
facts AS (SELECT i.project_id, coalesce(c.files, 0) AS files, coalesce(readme, '') AS readme, coalesce(anthropic, false) AS anthropic FROM (SELECT DISTINCT project_id FROM files) i
  LEFT JOIN (SELECT project_id, sum(files) AS files FROM counts GROUP BY ALL) c USING (project_id) LEFT JOIN readme USING (project_id) LEFT JOIN sdk USING (project_id)),
typed AS (SELECT project_id, anthropic, CASE WHEN {_like("readme", scope.RAG)} THEN 'rag' WHEN {_like("readme", scope.KEYWORDS)} THEN 'agent' ELSE 'default' END AS project_type,
  CASE WHEN files < 10 THEN 7 WHEN files <= 50 THEN 14 WHEN files <= 200 THEN 21 ELSE 30 END AS estimated_days FROM facts), params AS ({_parameters()}),
base AS (SELECT project_id, estimated_days, round(daily, 6) AS daily_cost, round(daily * estimated_days, 6) AS total_cost, 'low' AS confidence, 'heuristic' AS source, project_type, model, calls_per_day, tokens_in, tokens_out
  FROM typed JOIN params USING (project_type, anthropic))"""
MATRIX = f"""WITH {PRICES}, named AS (SELECT unnest(['gpt-4o', 'gpt-4o-mini', 'claude-3-5-sonnet-latest', 'claude-3-5-haiku-latest', 'gemini-2.5-pro', 'gemini-2.5-flash']) AS model),
matrix AS (SELECT doc_id AS prompt_id, model, greatest(1, length(text) // 4) AS input_tokens, 500 AS output_tokens, greatest(1, length(text) // 4) / 1e6 * pin + 500 / 1e6 * pout AS cost_per_call, {tier("model")} AS tier
  FROM documents, named JOIN prices ON price_model = model)"""
OPTIMIZE = f"""{USAGE}, {PROFILE}, always AS (SELECT * FROM {_values(dims.ALWAYS_SWITCH)} t(model, always_alt, always_pct)), shorts AS (SELECT * FROM {_values(dims.SHORT_OUTPUT_SWITCH)} t(model, short_alt, short_pct)),
tagged AS (SELECT p.*, {TASK} AS task, {tier("p.model")} AS tier, {provider("p.model")} AS provider, always_alt, always_pct, short_alt, short_pct, pout AS cur_out
  FROM profile p LEFT JOIN always USING (model) LEFT JOIN shorts USING (model) LEFT JOIN prices ON price_model = p.model),
branched AS (SELECT *, CASE WHEN always_alt IS NOT NULL THEN 'always' WHEN task = 'Light' AND tier = '{list(dims.TIERS)[0]}' THEN 'light' WHEN task = 'Heavy' AND tier = '{list(dims.TIERS)[0]}' THEN 'lateral'
  WHEN short_alt IS NOT NULL THEN 'short' END AS branch FROM tagged),
alts AS (SELECT *, CASE branch WHEN 'always' THEN always_alt WHEN 'short' THEN short_alt
  WHEN 'light' THEN (SELECT arg_min(tier_model, ordinal) FROM tiers WHERE tiers.tier = '{list(dims.TIERS)[1]}' AND {provider("tier_model")} = branched.provider)
  WHEN 'lateral' THEN (SELECT arg_min(tier_model, (pout, ordinal)) FROM tiers JOIN prices ON price_model = tier_model WHERE tiers.tier = '{list(dims.TIERS)[0]}' AND tier_model <> branched.model AND pout < coalesce(cur_out, 1e300)) END AS alternative
  FROM branched WHERE branch IS NOT NULL),
pcts AS (SELECT a.*, CASE branch WHEN 'always' THEN always_pct WHEN 'short' THEN short_pct ELSE CASE WHEN cur_out > 0 THEN 1 - coalesce(pout, 0) / cur_out ELSE 0 END END AS pct FROM alts a LEFT JOIN prices ON price_model = alternative WHERE alternative IS NOT NULL),
found AS (SELECT project_id, model, alternative, task, CASE branch WHEN 'always' THEN 'Newer/cheaper model (' || calls || ' calls)' WHEN 'light' THEN 'Short outputs (avg ' || CAST(round_even(avg_out, 0) AS BIGINT) || ' tok) safe for Tier 2'
  WHEN 'lateral' THEN 'Lateral Tier 1 move (' || calls || ' heavy calls)' ELSE short_calls || '/' || calls || ' calls have short outputs' END AS reason,
  CASE WHEN branch = 'short' THEN short_cost ELSE total_cost END * greatest(0, pct) AS savings FROM pcts WHERE (branch <> 'lateral' OR pct > 0.1) AND (branch <> 'short' OR short_calls > 0))"""
BACKTEST = USERS.replace("uu AS MATERIALIZED", "uu_all AS MATERIALIZED") + ", " + projects_of("uu_all").replace("proj AS MATERIALIZED", "proj_all AS MATERIALIZED") + f""",
cuts AS (SELECT unnest([5, 10, 20]) AS cut), each_day AS (SELECT project_id AS pid, CAST("timestamp" AS DATE) AS day, sum(cost_usd) AS cost FROM uu_all GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY day) AS rk FROM each_day WHERE cost > 0),
uu AS MATERIALIZED (SELECT {{'pid': pid, 'cut': cut}} AS project_id, CAST(day AS TIMESTAMP) AS "timestamp", 0 AS tokens_in, 0 AS tokens_out, cost AS cost_usd FROM ranked, cuts WHERE rk <= cut),
proj AS MATERIALIZED (SELECT * REPLACE ({{'pid': project_id, 'cut': cut}} AS project_id) FROM proj_all, cuts), {SERIES}, {CORE},
spent_all AS (SELECT pid, sum(cost) AS actual_total FROM each_day GROUP BY ALL),
tested AS (SELECT pid AS project_id, CAST(f.project_id.cut AS INTEGER) AS cut, projected_total, actual_total, abs(projected_total - actual_total) AS error FROM fin f JOIN spent_all ON pid = f.project_id.pid)"""
TRACKED = f"{RAW}, tracked AS (SELECT * FROM stat WHERE status = 'tracked'), {resolved('tracked')}"
STREAMED = f"{TRACKED}, su AS (SELECT t.*, {COST} AS cost_usd FROM tracked t LEFT JOIN resolved USING (model)), closed AS (SELECT max(\"timestamp\") - INTERVAL 10 MINUTE AS watermark FROM su)"


def closed_buckets(minutes: int, window: str, shown: int | None = None) -> str:
    """Buckets of windows that have ended by the watermark; their size as a column if it is to be shown."""
    return f"""{STREAMED} SELECT project_id, {f"{shown} AS minutes, " if shown else ""}{bucket('"timestamp"', minutes)} AS bucket, round(sum(cost_usd), 6) AS cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens
  FROM su, closed WHERE time_bucket(INTERVAL '{window}', "timestamp") + INTERVAL '{window}' <= watermark GROUP BY ALL"""


r = lambda cols, places=6: ", ".join(f"round({c}, {places}) AS {c}" for c in cols.split())

ORACLE_SQL: dict[str, str] = {
    "price_catalog": f"""{USAGE}, used AS (SELECT model, count(*) AS calls FROM usage GROUP BY ALL), listed AS (SELECT price_model AS model, pin AS input, pout AS output, {provider("price_model")} AS provider, {tier("price_model")} AS tier FROM prices)
SELECT model, input, output, provider, tier, CASE WHEN tier = 'Unknown' THEN '?' ELSE regexp_extract(tier, 'Tier (\\d)', 1) END AS tier_num, coalesce(calls, 0) AS calls FROM listed LEFT JOIN used USING (model)""",
    "resolve_model": f"WITH {CALLS}, {resolved('calls')} SELECT model, priced_as, input, output, count(*) AS calls FROM calls LEFT JOIN resolved USING (model) GROUP BY ALL",
    "usage_cost": f"{USAGE} SELECT id, project_id, model, tokens_in, tokens_out, round(cost_usd, 9) AS cost_usd FROM usage",
    "model_tier": f"WITH {CALLS}, c AS (SELECT model, count(*) AS calls FROM calls GROUP BY ALL) SELECT model, calls, {tier('c.model')} AS tier FROM c",
    "model_provider": f"WITH {CALLS} SELECT model, count(*) AS calls, {provider('model')} AS provider FROM calls GROUP BY ALL",
    "unknown_models": f"WITH {CALLS}, {resolved('calls')} SELECT model, count(*) AS calls FROM calls LEFT JOIN resolved USING (model) WHERE priced_as IS NULL GROUP BY ALL",
    "token_estimate": "SELECT doc_id AS prompt_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM documents",
    "calc_matrix": f"{MATRIX} SELECT prompt_id, model, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, round(cost_per_call, 9) AS cost_per_call, round(cost_per_call * 10, 9) AS cost_total, tier FROM matrix",
    "calc_extremes": f"{MATRIX} SELECT prompt_id, arg_min(model, (cost_per_call, model)) AS cheapest, arg_min(model, (-cost_per_call, model)) AS dearest, round(max(cost_per_call) / min(cost_per_call), 6) AS ratio FROM matrix GROUP BY prompt_id HAVING count(*) >= 2 AND max(cost_per_call) > 0",
    "daily_costs": f"{USAGE} SELECT project_id, CAST(day AS VARCHAR) AS day, round(cost, 6) AS cost, total_tokens FROM ({DAILY.format('usage')})",
    **{
        name: f"{USAGE} SELECT project_id, {bucket('\"timestamp\"', k)} AS bucket, round(sum(cost_usd), 6) AS cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens FROM usage GROUP BY ALL"
        for name, k in (("bucketed_costs", 15), ("bucketed_costs_7", 7))
    },
    "active_days": f'{USAGE} SELECT project_id, count(DISTINCT CAST("timestamp" AS DATE)) AS active_days FROM usage GROUP BY ALL',
    "project_totals": f"{USAGE} SELECT project_id, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS spend FROM usage GROUP BY ALL",
    "model_costs": f"{USAGE} SELECT project_id, model, round(sum(cost_usd), 6) AS cost FROM usage GROUP BY ALL",
    "model_tokens": f"{USAGE} SELECT project_id, model, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens FROM usage GROUP BY ALL",
    "model_profile": f"{USAGE}, {PROFILE} SELECT project_id, model, calls, {r('total_cost avg_in avg_out')} FROM profile",
    "short_outputs": f"{USAGE}, {PROFILE} SELECT project_id, model, short_calls, round(short_cost, 6) AS short_cost FROM profile",
    "session_summary": f"{USAGE} SELECT project_id, model, CASE WHEN grouping(model) = 1 THEN 'project' ELSE 'model' END AS level, round(sum(cost_usd), 6) AS cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, count(*) AS calls FROM usage GROUP BY GROUPING SETS ((project_id), (project_id, model))",
    "active_series": f"{USERS} SELECT project_id, CAST(day AS VARCHAR) AS day, round(cost, 6) AS cost, total_tokens FROM ({DAILY.format('uu')}) WHERE cost > 0",
    "recent_usage": f'{USAGE} SELECT project_id, id, "timestamp", model, tokens_in, tokens_out, round(cost_usd, 6) AS cost_usd, CAST(row_number() OVER w AS INTEGER) AS rank FROM usage WINDOW w AS (PARTITION BY project_id ORDER BY "timestamp" DESC, id DESC) QUALIFY row_number() OVER w <= 20',
    "recent_five": f'{USAGE} SELECT project_id, id, tokens_in + tokens_out AS tokens, CAST(row_number() OVER w AS INTEGER) AS rank FROM usage WINDOW w AS (PARTITION BY project_id ORDER BY "timestamp" DESC, id DESC) QUALIFY row_number() OVER w <= 5',
    "last_14_days": f"{USAGE}, d AS ({DAILY.format('usage')}), x AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day DESC) AS k, max(cost) OVER (PARTITION BY project_id) AS top FROM d) SELECT project_id, CAST(day AS VARCHAR) AS day, round(cost, 6) AS cost, CAST(k AS INTEGER) AS rank, round(CASE WHEN top > 0 THEN cost / top ELSE 0 END, 6) AS ratio FROM x WHERE k <= 14",
    "forecast_history": f"{USERS}, {HISTORY} SELECT project_id, iteration, round(projected_total, 6) AS projected_total FROM hist",
    "forecast_tail": f"{USERS}, {HISTORY} SELECT project_id, iteration, round(projected_total, 6) AS projected_total, CAST(row_number() OVER (PARTITION BY project_id ORDER BY iteration DESC) AS INTEGER) AS rank FROM hist QUALIFY rank <= 10",
    "convergence": f"{USERS}, {HISTORY}, x AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY iteration DESC) <= 5), y AS (SELECT *, max(projected_total) OVER p AS top, count(*) OVER p AS k FROM x WINDOW p AS (PARTITION BY project_id)) SELECT project_id, iteration, round(projected_total, 6) AS projected_total, round(CASE WHEN top > 0 THEN projected_total / top ELSE 0 END, 6) AS ratio FROM y WHERE k >= 2",
    "export_usage": f'{USAGE} SELECT project_id, "timestamp", model, provider, tokens_in, tokens_out, round(cost_usd, 6) AS cost_usd FROM usage QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, id DESC) <= 1000',
    "purge_usage": f"{USAGE} SELECT project_id, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS spend FROM usage WHERE project_id % 2 <> 0 GROUP BY ALL",
    "project_lookup": f"{USAGE}, {projects_of('usage')} SELECT project_id, path, name, CASE WHEN project_id % 5 <> 0 THEN 'agent' END AS project_type, CASE WHEN project_id % 5 <> 0 THEN project_id % 7 * 10 ELSE 0 END AS calls_per_day, CASE WHEN project_id % 5 <> 0 THEN CAST(project_id % 5 AS DOUBLE) END AS budget FROM proj",
    "purge_stored": f"{USAGE} SELECT project_id, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS spend FROM usage WHERE project_id % 2 <> 0 GROUP BY ALL",
    "usage_period": f"""{USAGE} SELECT id, project_id, "timestamp", model, provider, tokens_in, tokens_out, round(cost_usd, 6) AS cost_usd, 'api' AS source FROM usage
  WHERE "timestamp" >= TIMESTAMP '{PERIOD[0]}' AND "timestamp" < TIMESTAMP '{PERIOD[1]}'""",
    "old_usage": f"{USAGE} SELECT project_id, 'api' AS source, count(*) AS calls, round(sum(cost_usd), 6) AS spend FROM usage GROUP BY ALL",
    "export_json": f'{USAGE} SELECT id, project_id, "timestamp", model, provider, tokens_in, tokens_out, round(cost_usd, 6) AS cost_usd FROM usage QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, id DESC) <= 1000',
    "add_projects": f"{USAGE}, {projects_of('usage')} SELECT project_id, name, path, round(baseline_daily_cost, 6) AS baseline_daily_cost FROM proj WHERE project_id % 2 <> 0",
    "ingest_counts": f"{RAW} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("tracked", "skipped_streaming", "ignored", "error")) + ", count(*) FILTER (status = 'tracked') AS stored FROM stat",
    "stream_sizes": " UNION ALL ".join(f"SELECT * FROM ({closed_buckets(k, '15 minutes', k)})" for k in (15, 5, 1)),
    "ingest_usage": f"{RAW}, tracked AS (SELECT * FROM stat WHERE status = 'tracked'), {resolved('tracked')} {priced('tracked')}",
    "stream_ingest": f"{TRACKED} {priced('tracked')}",
    "stream_totals": f"{STREAMED} SELECT project_id, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS spend FROM su GROUP BY ALL",
    "stream_buckets": closed_buckets(15, "15 minutes"),
    "stream_buckets_7": closed_buckets(7, "1 hour"),
    "ingest_stream": f"{RAW.replace(SKIP, 'false')}, tracked AS (SELECT * FROM stat WHERE status = 'tracked'), {resolved('tracked')} {priced('tracked')}",
    "manual_calls": f"""{USAGE} SELECT project_id, "timestamp", model, provider, tokens_in, tokens_out, round(cost_usd, 6) AS cost_usd, CASE WHEN id % 3 = 0 THEN '{{"tag":"t' || id % 7 || '"}}' END AS metadata, 'api' AS source FROM usage""",
    "ingest_lenient": f"{RAW}{_LENIENT}, kept AS (SELECT * FROM lenient WHERE tokens_in IS NOT NULL AND tokens_out IS NOT NULL), {resolved('kept')} {priced('kept')}",
    "ingest_stats": f"{RAW} SELECT coalesce(project_id, 0) AS project_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("tracked", "skipped_streaming", "ignored", "error")) + " FROM stat GROUP BY ALL",
    "adaptive_buckets": f"{CHOICE} SELECT project_id, minutes, bucket, round(cost, 6) AS cost, total_tokens FROM adaptive",
    "series_choice": f"{CHOICE} SELECT project_id, use_buckets, n, active_days, remaining_days, horizon, round(buckets_per_day, 6) AS buckets_per_day, data_granularity, round(actual_spend, 6) AS actual_spend, total_tokens FROM choice",
    "ema_forecast": f"{CHOICE}, x AS (SELECT *, {EMA} AS ratio FROM choice) SELECT project_id, round(ratio, 6) AS ratio, round(greatest(0, ratio * base), 6) AS daily_forecast, remaining_days FROM x",
    "ses_fixed": f"{CHOICE}, {SES} SELECT project_id, round(level0, 6) AS level0, round(e.level, 6) AS level, round(e.sq, 6) AS sse, round(e.ab, 6) AS sae FROM ses_x",
    "ses_opt": f"{CHOICE}, {SES} SELECT project_id, round(alpha, 6) AS alpha, round(level0, 6) AS level0, round(e.level, 6) AS level, round(e.sq, 6) AS sse, round(e.ab, 6) AS sae FROM ses_o",
    "damped_trend": f"{CHOICE}, {DAMPED} SELECT project_id, {r('phi level trend sse alpha beta', 6)} FROM damped",
    "linear_forecast": f"{CHOICE}, {LINE} SELECT project_id, {r('slope intercept', 6)} FROM choice JOIN regr USING (project_id) WHERE n >= 3",
    "ensemble": f"{FULL} SELECT project_id, models_used, len(steps) AS steps, round(steps[1], 6) AS first_step, {r('projected_remaining projected_total', 6)} FROM fin",
    "intervals": f"{FULL} SELECT project_id, {r('pi80_lower pi80_upper pi95_lower pi95_upper', 6)} FROM fin",
    "accuracy": f"{FULL} SELECT project_id, {r('mase mae_dollars', 6)}, coalesce(mase < 1, false) AS beats_naive FROM fin",
    "drift": f"{FULL} SELECT project_id, round(smoothed_burn_ratio, 6) AS smoothed_burn_ratio, drift_status FROM fin",
    "confidence": f"{FULL} SELECT project_id, active_days, confidence FROM fin",
    "model_breakdown": f"{FULL}, {SHARES} SELECT project_id, model, {r('spent share projected', 6)} FROM shares",
    "stability": f"{FULL}, {STABLE} SELECT project_id, round(stability, 6) AS stability, stability_label, iteration FROM stab",
    "forecast": f"""{RECORD} SELECT fin.project_id, name AS project_name, {r("actual_spend projected_total projected_remaining smoothed_burn_ratio stability baseline_daily_cost baseline_total_cost mase mae_dollars pi80_lower pi80_upper pi95_lower pi95_upper", 6)},
  total_tokens, remaining_days, active_days, n AS data_points, data_granularity, baseline_total_days AS total_days, drift_status, confidence, stability_label, iteration, models_used,
  greatest(m, 1) AS n_models_used, coalesce(k, 0) AS breakdown_models FROM fin JOIN stab USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS k FROM shares GROUP BY ALL) USING (project_id)""",
    "forecast_rows": f"{RECORD} SELECT project_id, iteration, remaining_days AS projected_remaining_days, {r('projected_total smoothed_burn_ratio mase', 6)}, confidence, active_days AS active_days_count FROM fin JOIN stab USING (project_id)",
    "forecast_selected": f"{RECORD} SELECT project_id, iteration, remaining_days AS projected_remaining_days, {r('projected_total smoothed_burn_ratio mase', 6)}, confidence, active_days AS active_days_count FROM fin JOIN stab USING (project_id) WHERE project_id % 3 = 0",
    "forecast_saved": f"{RECORD} SELECT project_id, iteration, remaining_days AS projected_remaining_days, {r('projected_total smoothed_burn_ratio mase', 6)}, confidence, active_days AS active_days_count FROM fin JOIN stab USING (project_id)",
    "forecast_long": f"""{RECORD}, wide AS (SELECT project_id, actual_spend::DOUBLE AS actual_spend, projected_total::DOUBLE AS projected_total, projected_remaining::DOUBLE AS projected_remaining, remaining_days::DOUBLE AS remaining_days,
  active_days::DOUBLE AS active_days, baseline_total_days::DOUBLE AS total_days, smoothed_burn_ratio::DOUBLE AS smoothed_burn_ratio FROM fin)
SELECT project_id, metric, round(value, 4) AS value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE project_id) INTO NAME metric VALUE value) UNION ALL SELECT project_id, 'model:' || model, round(projected, 4) FROM shares""",
    "status": f"""{RECORD} SELECT project_id, name AS project_name, total_tokens AS tokens, round(actual_spend, 6) AS spent, round(projected_total, 6) AS projected, active_days AS day, baseline_total_days AS total_days, drift_status AS drift,
  round(CASE WHEN projected_total > 0 THEN actual_spend / projected_total * 100 ELSE 0 END, 6) AS progress, actual_spend = 0 AND total_tokens > 0 AS subscription,
  list_position(['low', 'medium-low', 'medium', 'high', 'very-high'], confidence) AS confidence_level FROM fin""",
    "status_brief": f"""{RECORD} SELECT project_id, name AS project_name, round(actual_spend, 6) AS spent, round(projected_total, 6) AS projected, active_days AS day, baseline_total_days AS total_days, drift_status AS drift,
  round(CASE WHEN projected_total > 0 THEN actual_spend / projected_total * 100 ELSE 0 END, 6) AS progress, actual_spend = 0 AND total_tokens > 0 AS subscription,
  list_position(['low', 'medium-low', 'medium', 'high', 'very-high'], confidence) AS confidence_level FROM fin""",
    "forecast_json": f"{RECORD} SELECT project_id, name AS project_name, {r('actual_spend projected_total smoothed_burn_ratio mase')}, drift_status, models_used, coalesce(k, 0) AS breakdown_models, 26 AS fields FROM fin LEFT JOIN (SELECT project_id, count(*) AS k FROM shares GROUP BY ALL) USING (project_id)",
    "backtest": f"{BACKTEST} SELECT project_id, cut, {r('projected_total actual_total error')}, round(error / nullif(actual_total, 0) * 100, 6) AS error_pct FROM tested",
    "project_status": f'{UP}, d AS (SELECT project_id, count(DISTINCT CAST("timestamp" AS DATE)) AS active_days, sum(cost_usd) AS actual_spend FROM uu GROUP BY ALL) SELECT project_id, name, round(baseline_daily_cost, 6) AS baseline_daily_cost, baseline_total_days, round(baseline_total_cost, 6) AS baseline_total_cost, active_days, round(actual_spend, 6) AS actual_spend FROM proj LEFT JOIN d USING (project_id)',
    "budget_status": f"{FULL} SELECT project_id, round(budget, 6) AS budget, CASE WHEN budget IS NULL THEN 0 WHEN actual_spend > budget THEN 2 WHEN projected_total > budget THEN 1 ELSE 0 END AS code FROM fin",
    "task_class": f"{USAGE}, {PROFILE} SELECT project_id, model, {TASK} AS task FROM profile",
    "optimize": f"{OPTIMIZE} SELECT project_id, model, alternative, task, reason, round(savings, 6) AS savings FROM found",
    "optimize_totals": f"{OPTIMIZE} SELECT project_id, count(*) AS suggestions, round(sum(savings), 6) AS savings FROM found GROUP BY ALL",
    "scope_ext_counts": f"{FILES} SELECT * FROM counts",
    "scope_baseline": f"{BASELINE} SELECT * FROM base",
    "baseline_budget": f"{BASELINE} SELECT project_id AS id, round(daily_cost * estimated_days, 6) AS baseline_total_cost, CASE WHEN daily_cost * estimated_days <= 20.0 THEN 'under' ELSE 'over' END AS against_budget FROM base",
}
