"""The SQL each registered query must agree with, for an engine without this package."""

from __future__ import annotations

# Fixed values, written out again so that a wrong one in the package shows.
LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
RUNGS = ["q01", "q05", "q25", "q50", "q75", "q95", "q99"]
KINDS = ("cpu_saturation", "memory_leak", "latency_injection", "error_spike", "dependency_failure", "deploy_regression")
PROPAGATING_METRICS = ("latency_p95_ms", "error_rate")
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
GAUSSIAN_TWO_SIDED = {2.0: 0.0455, 2.5: 0.0124, 3.0: 0.0027, 3.5: 0.000465}
GAUGES = ("request_rate_rps", "latency_p95_ms", "error_rate", "cpu_pct", "mem_mb")
SERVICES = 6
# kind, metric, ramp share, floor and half-life of the decay, gain, power, offset
EFFECTS = (
    ("cpu_saturation", "cpu_pct", 0.08, 1.0, 1.0, 2.6, 1.0, 0.0),
    ("cpu_saturation", "latency_p95_ms", 0.08, 1.0, 1.0, 2.0, 1.0, 0.0),
    ("cpu_saturation", "error_rate", 0.08, 1.0, 1.0, 4.0, 1.0, 0.6),
    ("memory_leak", "mem_mb", 1.0, 1.0, 1.0, 1.4, 1.0, 0.0),
    ("memory_leak", "latency_p95_ms", 1.0, 1.0, 1.0, 0.7, 3.0, 0.0),
    ("memory_leak", "cpu_pct", 1.0, 1.0, 1.0, 0.4, 2.0, 0.0),
    ("latency_injection", "latency_p95_ms", 0.02, 1.0, 1.0, 4.5, 1.0, 0.0),
    ("latency_injection", "error_rate", 0.02, 1.0, 1.0, 1.5, 1.0, 0.0),
    ("error_spike", "error_rate", 0.02, 0.45, 0.35, 70.0, 1.0, 0.0),
    ("error_spike", "latency_p95_ms", 0.02, 0.45, 0.35, 0.5, 1.0, 0.0),
    ("dependency_failure", "error_rate", 0.03, 1.0, 1.0, 90.0, 1.0, 0.0),
    ("dependency_failure", "latency_p95_ms", 0.03, 1.0, 1.0, 2.5, 1.0, 0.0),
    ("dependency_failure", "request_rate_rps", 0.03, 1.0, 1.0, -0.55, 1.0, 0.0),
    ("deploy_regression", "latency_p95_ms", 0.01, 1.0, 1.0, 0.85, 1.0, 0.0),
    ("deploy_regression", "cpu_pct", 0.01, 1.0, 1.0, 0.55, 1.0, 0.0),
)


def r(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6)"


EV = """ev AS (
  SELECT event_id, ts, date_trunc('hour', ts) AS hour, 's' || (user_id // 1500 * 6 + user_id % 6) AS service, user_id, event_type, value, props
  FROM events)"""

TEL = f"""{EV},
per_hour AS (
  SELECT hour AS timestamp, service, count(*) / CAST(3600 AS DOUBLE) AS request_rate_rps,
    CAST(quantile_cont(value, 0.95) AS DOUBLE) AS latency_p95_ms,
    avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS error_rate,
    least(avg(value), CAST(100 AS DOUBLE)) AS cpu_pct, max(value) AS mem_mb
  FROM ev GROUP BY hour, service),
tel AS ({" UNION ALL ".join(f"SELECT timestamp, service, '{m}' AS metric, {m} AS value FROM per_hour" for m in GAUGES)})"""

GRID = f"""{TEL},
axis AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS pos FROM (SELECT DISTINCT timestamp FROM tel)),
series AS (SELECT DISTINCT service, metric FROM tel),
cells AS (SELECT timestamp, service, metric, avg(value) AS value FROM tel WHERE value IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT a.timestamp, a.pos, s.service, s.metric, c.value
  FROM axis a CROSS JOIN series s
  LEFT JOIN cells c ON c.timestamp = a.timestamp AND c.service = s.service AND c.metric = s.metric)"""

SPLIT = "(SELECT CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) FROM axis)"
W = "PARTITION BY service, metric ORDER BY pos"

SERVICE_HOPS = """calls AS (
  SELECT DISTINCT service AS caller, 's' || (user_id // 1500 * 6 + least(5, user_id % 6 + 1 + event_id % 2)) AS callee FROM ev
  WHERE user_id % 6 <> least(5, user_id % 6 + 1 + event_id % 2)),
walk(origin, service, hops) AS (
  SELECT callee, caller, 1 FROM calls
  UNION
  SELECT w.origin, c.caller, w.hops + 1 FROM walk w JOIN calls c ON c.callee = w.service
  WHERE c.caller <> w.origin),
hops AS (SELECT origin, service, min(hops) AS hops FROM walk GROUP BY origin, service),
radius AS (
  SELECT root, string_agg(service, ',' ORDER BY service) AS affected_services FROM (
    SELECT DISTINCT service AS root, service FROM ev UNION SELECT origin, service FROM hops) GROUP BY root)"""

_kind_case = "CASE CASE WHEN long_ THEN day(ts) % 6 ELSE event_id % 5 END " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
FAULTS = f"""{SERVICE_HOPS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) = 1 AS long_
  FROM ev WHERE event_type = 'error'),
faults AS (
  SELECT *, start + to_seconds(duration_s) AS finish FROM (
    SELECT event_id AS ordinal, {_kind_case} AS kind, service, ts AS start,
      CAST(CASE WHEN long_ THEN 28800 ELSE 60 * (1 + event_id % 3) END AS BIGINT) AS duration_s,
      CAST(0.35 AS DOUBLE) + (event_id % 66) / CAST(100 AS DOUBLE) AS magnitude
    FROM ranked)),
incidents AS (
  SELECT f.ordinal, printf('INC-%04d', f.ordinal) AS incident_id, f.kind, f.service AS root_service, f.start,
    f.finish, f.magnitude, f.kind = 'deploy_regression' AS permanent, d.affected_services
  FROM faults f JOIN radius d ON d.root = f.service),
effects(kind, metric, ramp, floor_, half_life, gain, power, off, at_caller) AS (VALUES {", ".join(
    f"('{k}', '{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE, {str(m in PROPAGATING_METRICS).lower()})"
    for k, m, a, b, c, d, e, f in EFFECTS)})"""

CLAIMS = """claims AS (
  SELECT DISTINCT i.ordinal, i.incident_id, u.service, e.metric, i.start, i.finish
  FROM incidents i, unnest(string_split(i.affected_services, ',')) AS u(service)
  JOIN effects e ON e.kind = i.kind
  WHERE u.service = i.root_service OR e.at_caller)"""

LABELLED = f"""{FAULTS}, {CLAIMS},
firsts AS (
  SELECT t.timestamp, t.service, t.metric, arg_min(c.incident_id, c.ordinal) AS incident_id
  FROM tel t JOIN claims c ON c.service = t.service AND c.metric = t.metric AND t.timestamp BETWEEN c.start AND c.finish
  GROUP BY t.timestamp, t.service, t.metric),
labelled AS (
  SELECT t.timestamp, t.service, t.metric, t.value, f.incident_id IS NOT NULL AS is_anomalous,
    coalesce(f.incident_id, '') AS incident_id
  FROM tel t LEFT JOIN firsts f ON f.timestamp = t.timestamp AND f.service = t.service AND f.metric = t.metric)"""

FULL = f"WITH RECURSIVE {GRID}, {LABELLED}"

_levels = "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in LEVELS) + "]"


def changes(name: str, where: str) -> str:
    """Anchor and target over the part of the labelled grid the condition selects."""
    return f"""{name} AS (
  SELECT *, value - anchor AS target FROM (
    SELECT *, lag(value) OVER ({W}) AS anchor, coalesce(lag(clean) OVER ({W}), false) AS clean_before
    FROM (SELECT g.*, coalesce(NOT l.is_anomalous, false) AS clean FROM grid g LEFT JOIN labelled l
      ON l.timestamp = g.timestamp AND l.service = g.service AND l.metric = g.metric) WHERE {where}))"""


TRAIN = f"""{FULL}, {changes("early", f"pos < {SPLIT}")},
train AS (SELECT * FROM early WHERE target IS NOT NULL AND clean AND clean_before)"""

MODEL = f"""{TRAIN},
by_hour AS (
  SELECT service, metric, hour(timestamp) AS hour, quantile_cont(target, {[float(p) for p in LEVELS]}) AS quantiles
  FROM train GROUP BY ALL HAVING count(*) >= 40),
overall AS (
  SELECT service, metric, quantile_cont(target, {[float(p) for p in LEVELS]}) AS quantiles FROM train GROUP BY ALL)"""

PREDICTED = f"""{MODEL}, {changes("late", f"pos >= {SPLIT}")},
laddered AS (
  SELECT t.*, coalesce(h.quantiles, o.quantiles) AS qs FROM late t
  LEFT JOIN by_hour h ON h.service = t.service AND h.metric = t.metric AND h.hour = hour(t.timestamp)
  LEFT JOIN overall o ON o.service = t.service AND o.metric = t.metric
  WHERE t.value IS NOT NULL),
predicted AS (
  SELECT *, CASE WHEN anchor IS NOT NULL AND qs IS NOT NULL THEN list_sort(list_transform(qs, lambda x: x + anchor)) END AS q
  FROM laddered)"""

PIT = f"""{PREDICTED},
reach AS (
  SELECT *, len(list_filter(q, lambda x: x <= value)) AS j FROM predicted WHERE q IS NOT NULL),
pits AS (
  SELECT timestamp, service, metric, clean, CASE WHEN j = 0 THEN CAST(0 AS DOUBLE)
    WHEN j = {len(LEVELS)} THEN CASE WHEN value = q[{len(LEVELS)}] THEN CAST({LEVELS[-1]} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    ELSE {_levels}[j] + (value - q[j]) / (q[j + 1] - q[j]) * ({_levels}[j + 1] - {_levels}[j]) END AS pit
  FROM reach)"""


def ks(source: str, by: str = "") -> str:
    """Per distinct value: running count against the value."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""counted AS (SELECT {keys}pit, count(*) AS c FROM {source} GROUP BY {keys}pit),
ran AS (SELECT *, sum(c) OVER ({part} ORDER BY pit) AS upto, sum(c) OVER ({part}) AS n FROM counted)
SELECT {keys}{r("max(greatest(upto / CAST(n AS DOUBLE) - pit, pit - (upto - c) / CAST(n AS DOUBLE)))")} AS ks,
  CAST(sum(c) AS BIGINT) AS n FROM ran {"GROUP BY " + by if by else ""}"""


def histogram(source: str, bins: int) -> str:
    width = f"CAST({1.0 / bins!r} AS DOUBLE)"
    return f"""guess AS (SELECT pit, least(CAST(floor(pit * {bins}) AS BIGINT), {bins - 1}) AS g FROM {source}),
binned AS (
  SELECT CASE WHEN pit < g * {width} THEN g - 1 WHEN pit >= (g + 1) * {width} AND g < {bins - 1} THEN g + 1 ELSE g END AS bin
  FROM guess),
counts AS (SELECT bin, count(*) AS c FROM binned GROUP BY bin)
SELECT s.bin AS bin, {r(f"s.bin * {width}")} AS "from", {r(f"CASE WHEN s.bin = {bins - 1} THEN 1 ELSE (s.bin + 1) * {width} END")} AS "to",
  coalesce(c, 0) AS observed, {r(f"coalesce(c, 0) / nullif((SELECT sum(c) FROM counts) / CAST({bins} AS DOUBLE), 0)")} AS ratio
FROM (SELECT unnest(range(0, {bins})) AS bin) s LEFT JOIN counts ON counts.bin = s.bin"""


def rungs_of(array: str, names: list[str] = RUNGS) -> str:
    return ", ".join(f"{r(f'{array}[{i + 1}]')} AS {n}" for i, n in enumerate(names))


NAIVE = f"""lags AS (
  SELECT *, list_sort(list_filter([lag(value, 24) OVER w, lag(value, 48) OVER w, lag(value, 72) OVER w], lambda x: x IS NOT NULL)) AS ls
  FROM grid WINDOW w AS ({W})),
naive AS (
  SELECT *, CASE len(ls) WHEN 0 THEN NULL WHEN 1 THEN ls[1] WHEN 2 THEN (ls[1] + ls[2]) / 2 ELSE ls[2] END AS predicted FROM lags)"""

EWMA = f"""sums AS (
  SELECT *, sum(value * pow(CAST(2 AS DOUBLE), pos / CAST(20 AS DOUBLE))) OVER w AS num,
    sum(CASE WHEN value IS NOT NULL THEN pow(CAST(2 AS DOUBLE), pos / CAST(20 AS DOUBLE)) END) OVER w AS den, count(value) OVER w AS cnt
  FROM grid WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
smoothed AS (SELECT *, CASE WHEN cnt >= 5 THEN num / den END AS ewma FROM sums)"""



def sigma(width: int) -> str:
    return f"""rolled AS (
  SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n,
    min(value) OVER w AS lo, max(value) OVER w AS hi
  FROM grid WINDOW w AS ({W} ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)),
sigma AS (
  SELECT *, CASE WHEN n >= {width // 4} THEN m END AS mean, CASE WHEN n >= {width // 4} THEN CASE WHEN lo = hi THEN 0 ELSE s END END AS std FROM rolled)"""


SIGMA = sigma(48)

STEP = """(SELECT CAST(quantile_cont(gap, 0.5) AS DOUBLE) FROM (
  SELECT (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (ORDER BY timestamp))) / CAST(1000000 AS DOUBLE) AS gap FROM axis))"""

RATE = """(SELECT fired / (cells * step / CAST(86400 AS DOUBLE)) FROM counted)"""


def alerts(select: str) -> str:
    return f"""WITH {GRID}, {SIGMA},
counted AS (
  SELECT CAST(sum(CASE WHEN abs(value - mean) > 3 * std AND std > 0 THEN 1 ELSE 0 END) AS BIGINT) AS fired, count(*) AS cells,
    {STEP} AS step FROM sigma)
SELECT {select} FROM counted"""


LAGS = ", ".join(f"{r(f'lag(value, {n}) OVER w')} AS lag_{n}" for n in (1, 2, 4, 8, 16)) + ", " + ", ".join(
    f"{r(f'lag(value, 1) OVER w - lag(value, {n + 1}) OVER w')} AS delta_{n}" for n in (1, 4)
)


def rolls(*widths: int) -> str:
    return ", ".join(
        f"{r(f'CASE WHEN count(value) OVER w{n} >= {n // 4} THEN avg(value) OVER w{n} END')} AS mean_{n}, "
        f"{r(f'CASE WHEN count(value) OVER w{n} >= {n // 4} THEN stddev_samp(value) OVER w{n} END')} AS std_{n}"
        for n in widths
    )


ROLLS = rolls(24, 72)
DAILY = ", ".join(f"{r(f'lag(value, {24 * n}) OVER w')} AS lag_day_{n}" for n in (1, 2))
CLOCK = ", ".join(
    f"{r(f'{fn}(2 * pi() * fmod(epoch_us({{t}}) / CAST(1000000 AS DOUBLE), {p}) / {p})')} AS {name}_{fn}"
    for name, p in (("day", 86400), ("week", 604800))
    for fn in ("sin", "cos")
)
WINDOWS = f"""WINDOW w AS ({W}), w24 AS ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
  w72 AS ({W} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)"""


def feature_query(columns: str) -> str:
    return f"WITH {GRID} SELECT timestamp, service, metric, {columns} FROM grid {WINDOWS}"


COUNTERS = f"""{EV},
per AS (
  SELECT hour AS timestamp, service, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, count(*) AS n
  FROM ev GROUP BY ALL),
counters AS (
  SELECT timestamp, service, status, CAST(sum(n) OVER (
    PARTITION BY service, status, CAST(timestamp AS DATE) ORDER BY timestamp) AS DOUBLE) AS value FROM per),
stepped AS (
  SELECT *, lag(value) OVER w AS before, lag(timestamp) OVER w AS seen FROM counters
  WINDOW w AS (PARTITION BY service, status ORDER BY timestamp)),
grown AS (
  SELECT timestamp, service, status, CASE WHEN value < before THEN value ELSE value - before END AS increase FROM stepped
  WHERE before IS NOT NULL AND epoch(timestamp) - epoch(seen) < 7200),
rates AS (
  SELECT timestamp + k * INTERVAL 1 HOUR AS timestamp, service, status, sum(increase) / CAST(7200 AS DOUBLE) AS value
  FROM grown, (VALUES (0), (1)) AS steps(k) GROUP BY timestamp + k * INTERVAL 1 HOUR, service, status)"""

WINDOWED = f"""WITH RECURSIVE {GRID}, {FAULTS},
placed AS (
  SELECT f.*, (SELECT count(*) FROM axis a WHERE a.timestamp < f.start) AS first_pos,
    CASE WHEN f.kind = 'deploy_regression' THEN (SELECT count(*) FROM axis)
      ELSE (SELECT count(*) FROM axis a WHERE a.timestamp < f.finish) END AS stop_pos FROM faults f),
windows AS (SELECT *, stop_pos - first_pos AS n FROM placed WHERE stop_pos > first_pos)"""


def factor(i: str) -> str:
    steps = "greatest(CAST(1 AS DOUBLE), round_even(n * ramp, 0))"
    shape = (
        f"least({i} / {steps}, CAST(1 AS DOUBLE)) * (floor_ + (1 - floor_) * "
        f"pow(CAST(0.5 AS DOUBLE), {i} / greatest(CAST(1 AS DOUBLE), n * half_life)))"
    )
    return f"1 + gain * magnitude * pow(greatest({shape} - off, CAST(0 AS DOUBLE)) / (1 - off), power)"


# every profile is spelled out row by row here, so that its peak is found by looking
SPREAD = f"""{WINDOWED},
touched AS (
  SELECT w.ordinal, w.kind, w.n, w.magnitude, w.first_pos, w.service, 0 AS hops FROM windows w
  UNION ALL
  SELECT w.ordinal, w.kind, w.n, w.magnitude, w.first_pos, h.service, h.hops FROM windows w JOIN hops h ON h.origin = w.service),
profile AS (
  SELECT t.ordinal, t.service, e.metric, t.hops, t.first_pos + 4 * t.hops AS from_pos, t.first_pos + 4 * t.hops + u.i AS pos,
    CASE WHEN t.hops = 0 THEN {factor("u.i")} ELSE 1 + ({factor("u.i")} - 1) * pow(CAST(0.55 AS DOUBLE), t.hops) END AS factor
  FROM touched t JOIN effects e ON e.kind = t.kind AND (t.hops = 0 OR e.at_caller), unnest(range(0, t.n)) AS u(i)
  WHERE t.first_pos + 4 * t.hops + u.i < (SELECT count(*) FROM axis)),
felt AS (
  SELECT *, max(abs(factor - 1)) OVER (PARTITION BY ordinal, service, metric) AS peak FROM profile),
kept AS (SELECT * FROM felt WHERE hops = 0 OR peak > 0.05)"""

OVERLAID = f"""{SPREAD},
hit AS (
  SELECT service, metric, pos, product(factor) AS factor, bool_or(abs(factor - 1) > 0.05) AS active,
    min(CASE WHEN abs(factor - 1) > 0.05 THEN ordinal END) AS first
  FROM kept GROUP BY service, metric, pos)
SELECT g.timestamp, g.service, g.metric"""

_hit = "FROM grid g LEFT JOIN hit h ON h.service = g.service AND h.metric = g.metric AND h.pos = g.pos"
_bounded = "greatest(CAST(0 AS DOUBLE), least(CASE metric WHEN 'error_rate' THEN 1 WHEN 'cpu_pct' THEN 100 ELSE CAST('inf' AS DOUBLE) END, {v}))"

USER_GRAPH = """links AS (
  SELECT DISTINCT 'u' || user_id AS caller, 'u' || callee AS callee FROM (
    SELECT user_id, user_id // 2 AS callee FROM events UNION SELECT user_id, user_id // 3 FROM events)
  WHERE user_id <> callee)"""


def side(metric: str, when: str) -> str:
    return f"(SELECT median FROM med m WHERE m.service = b.service AND m.metric = '{metric}' AND m.side = '{when}')"


def interval(lo: int, hi: int, condition: str) -> str:
    return f"avg(CASE WHEN q IS NOT NULL AND {condition} THEN CASE WHEN value >= q[{lo}] AND value <= q[{hi}] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)"


def _loss(predicted: str, level: float) -> str:
    return (
        f"avg(CASE WHEN value - {predicted} >= 0 THEN CAST({level} AS DOUBLE) * (value - {predicted}) "
        f"ELSE CAST({level - 1} AS DOUBLE) * (value - {predicted}) END)"
    )


SCORED = f"""{PREDICTED}, {NAIVE}, {EWMA},
scored AS (
  SELECT p.*, n.predicted AS seasonal, s.ewma AS ewma FROM predicted p
  JOIN naive n ON n.pos = p.pos AND n.service = p.service AND n.metric = p.metric
  JOIN smoothed s ON s.pos = p.pos AND s.service = p.service AND s.metric = p.metric)"""
_three = {"forecaster": "q[4]", "seasonal": "seasonal", "ewma": "ewma"}

ORACLES: dict[str, str] = {
    "prom_matrix_to_long": f"WITH {TEL} SELECT timestamp, service, metric, {r('value')} AS value FROM tel WHERE value IS NOT NULL",
    "incidents_flat": f"""WITH RECURSIVE {EV}, {FAULTS}
SELECT ordinal, incident_id, kind, root_service, start, finish AS "end", {r("magnitude")} AS magnitude, permanent, affected_services
FROM incidents""",
    "request_rate": f"WITH {COUNTERS} SELECT timestamp, service, {r('sum(value)')} AS value FROM rates GROUP BY timestamp, service",
    "event_rate": f"WITH {EV} SELECT hour AS timestamp, service, {r('count(*) / CAST(3600 AS DOUBLE)')} AS value FROM ev GROUP BY hour, service",
    "error_ratio": f"""WITH {COUNTERS}
SELECT timestamp, service, {r("sum(CASE WHEN status LIKE '5__' THEN value END) / greatest(sum(value), 1e-9)")} AS value
FROM rates GROUP BY timestamp, service HAVING sum(CASE WHEN status LIKE '5__' THEN value END) IS NOT NULL""",
    "latency_p95_hist": f"""WITH {EV},
bounds(i, le, low) AS (VALUES {", ".join(f"({i}, CAST({b} AS DOUBLE), CAST({([0.0, *LATENCY_BOUNDS])[i]} AS DOUBLE))" for i, b in enumerate(LATENCY_BOUNDS))}, ({len(LATENCY_BOUNDS)}, CAST('inf' AS DOUBLE), CAST({LATENCY_BOUNDS[-1]} AS DOUBLE))),
held AS (
  SELECT hour, service, i, le, low, count(CASE WHEN value / CAST(100 AS DOUBLE) <= le THEN 1 END) AS cum FROM ev CROSS JOIN bounds GROUP BY ALL),
ranked AS (
  SELECT *, max(cum) OVER (PARTITION BY hour, service) * CAST(0.95 AS DOUBLE) AS rank, coalesce(lag(cum) OVER (PARTITION BY hour, service ORDER BY i), 0) AS under
  FROM held),
hits AS (SELECT *, row_number() OVER (PARTITION BY hour, service ORDER BY i) AS nth FROM ranked WHERE cum >= rank)
SELECT hour AS timestamp, service, {r("1000 * CASE WHEN le = CAST('inf' AS DOUBLE) THEN low ELSE low + (le - low) * (rank - under) / (cum - under) END")} AS value
FROM hits WHERE nth = 1""",
    "latency_p95_exact": f"WITH {EV} SELECT hour AS timestamp, service, {r('quantile_cont(value, 0.95)')} AS value FROM ev GROUP BY hour, service",
    "gauge_last": f"""WITH {EV},
placed AS (
  SELECT service, value, ts, CASE WHEN ts = hour THEN hour ELSE hour + INTERVAL 1 HOUR END AS step FROM ev)
SELECT step AS timestamp, service, {r("arg_max(value, ts)")} AS value FROM placed GROUP BY step, service""",
    "grid_resample": f"""WITH {EV},
bounds AS (SELECT date_trunc('hour', min(ts)) + INTERVAL 30 MINUTE AS low, max(ts) AS high FROM ev),
steps AS (SELECT unnest(range(low, high + INTERVAL 1 MICROSECOND, INTERVAL 15 MINUTE)) AS step FROM bounds)
SELECT step AS timestamp, service, {r("arg_max(value, ts)")} AS value
FROM steps JOIN ev ON ts <= step AND ts > step - INTERVAL 2 HOUR GROUP BY step, service""",
    "grid_dense": f"WITH {GRID} SELECT timestamp, pos, service, metric, {r('value')} AS value FROM grid",
    "wide_pivot": f"""WITH {TEL} SELECT timestamp, {", ".join(
        f"{r(f'''max(CASE WHEN service = 's{i}' AND metric = '{m}' THEN value END)''')} AS \"s{i}/{m}\"" for i in range(SERVICES) for m in GAUGES)}
FROM tel GROUP BY timestamp""",
    "wide_unpivot": f"WITH {GRID} SELECT timestamp, service, metric, {r('value')} AS value FROM grid",
    "step_seconds": f"WITH {GRID} SELECT {r(STEP)} AS step_seconds",
    "clean_mask": f"""WITH {EV}
SELECT hour AS timestamp, service, 'event_value' AS metric, {r("avg(value)")} AS value, arg_min(event_type, event_id) <> 'error' AS clean
FROM ev GROUP BY hour, service""",
    "chrono_split": f"""WITH {GRID}
SELECT CASE WHEN pos < {SPLIT} THEN 'train' ELSE 'test' END AS part, service, metric, count(*) AS cells, min(timestamp) AS first,
  max(timestamp) AS last FROM grid WHERE value IS NOT NULL GROUP BY part, service, metric""",
    "residuals": f"""WITH {GRID}, {NAIVE}
SELECT timestamp, service, metric, {r("value")} AS value, {r("predicted")} AS predicted, {r("value - predicted")} AS residual FROM naive""",
    "clip_bounds": f"""WITH {TEL}, moved AS (
  SELECT timestamp, service, metric, value * 2 - CASE WHEN metric = 'error_rate' THEN 0.5::DOUBLE ELSE 20.0::DOUBLE END AS v FROM tel)
SELECT timestamp, service, metric, {r(_bounded.format(v="v"))} AS value FROM moved""",
    "seasonal_naive": f"WITH {GRID}, {NAIVE} SELECT timestamp, service, metric, {r('predicted')} AS predicted FROM naive",
    "ewma": f"WITH {GRID}, {EWMA} SELECT timestamp, service, metric, {r('ewma')} AS predicted FROM smoothed",
    "k_sigma_alerts": f"""WITH {GRID}, {SIGMA}
SELECT timestamp, service, metric, coalesce(abs(value - mean) > 3 * std AND std > 0, false) AS alert FROM sigma""",
    "k_sigma_alerts_240": f"""WITH {GRID}, {sigma(240)}
SELECT timestamp, service, metric, coalesce(abs(value - mean) > 3 * std AND std > 0, false) AS alert FROM sigma""",
    "alert_rate": alerts(f"fired AS alerts, cells, {r(RATE)} AS alerts_per_series_per_day"),
    "alert_projection": alerts(f"{r(RATE)} AS alerts_per_series_per_day, {r(f'{RATE} * 5000')} AS daily_alerts"),
    "threshold_cost_report": f"""WITH {GRID}, {SIGMA},
ks(k, gaussian_rate) AS (VALUES {", ".join(f"(CAST({k} AS DOUBLE), CAST({g} AS DOUBLE))" for k, g in GAUSSIAN_TWO_SIDED.items())}),
counted AS (
  SELECT k, gaussian_rate, CAST(sum(CASE WHEN abs(value - mean) > k * std AND std > 0 THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
    count(*) AS cells FROM sigma CROSS JOIN ks GROUP BY k, gaussian_rate),
rated AS (SELECT *, alerts / (cells * {STEP} / CAST(86400 AS DOUBLE)) AS per_day FROM counted)
SELECT k, alerts, {r("gaussian_rate")} AS gaussian_rate, {r("per_day")} AS alerts_per_series_per_day,
  {r(f"per_day / (86400 / {STEP})")} AS observed_rate, {r(f"per_day / (86400 / {STEP}) / gaussian_rate")} AS inflation,
  {r("per_day * 5000")} AS fleet_daily_alerts FROM rated""",
    "features_lags": feature_query(LAGS),
    "features_rolling": feature_query(ROLLS),
    "features_rolling_240": f"""WITH {GRID} SELECT timestamp, service, metric, {rolls(60, 240)} FROM grid
WINDOW w60 AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), w240 AS ({W} ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)""",
    "features_daily": feature_query(DAILY),
    "features_calendar": f"SELECT ts AS timestamp, {CLOCK.format(t='ts')} FROM (SELECT DISTINCT ts FROM events)",
    "features_all": feature_query(f"{LAGS}, {ROLLS}, {DAILY}, {CLOCK.format(t='timestamp')}"),
    "change_target": f"""WITH {GRID}
SELECT timestamp, service, metric, {r("lag(value) OVER w")} AS anchor, {r("value - lag(value) OVER w")} AS target FROM grid WINDOW w AS ({W})""",
    "training_rows": f"{TRAIN} SELECT timestamp, service, metric, {r('anchor')} AS anchor, {r('target')} AS target FROM train",
    "train_row_counts": f"""{TRAIN}
SELECT s.service, s.metric, count(t.pos) AS rows FROM series s LEFT JOIN train t ON t.service = s.service AND t.metric = s.metric
GROUP BY s.service, s.metric""",
    "quantile_ladder": f"""{MODEL}
SELECT service, metric, CAST(hour AS BIGINT) AS hour, {rungs_of("quantiles")} FROM by_hour
UNION ALL SELECT service, metric, NULL, {rungs_of("quantiles")} FROM overall""",
    "boosted_quality": f"""{PREDICTED}
SELECT metric, count(*) AS rows, count(*) FILTER (q IS NULL) AS without_ladder, true AS ordered, true AS not_worse FROM predicted GROUP BY metric""",
    "predict_history": f"""WITH {GRID},
full_ AS (SELECT *, lag(value) OVER w AS a, lag(value, 24) OVER w AS d FROM grid WINDOW w AS ({W})),
slice AS (SELECT *, lag(value) OVER w AS a, lag(value, 24) OVER w AS d FROM (SELECT * FROM grid WHERE pos >= {SPLIT}) WINDOW w AS ({W}))
SELECT s.timestamp, s.service, s.metric, {r("s.a")} AS lag_1, {r("s.d")} AS lag_day_1, {r("f.a")} AS lag_1_full, {r("f.d")} AS lag_day_1_full
FROM slice s JOIN full_ f ON f.pos = s.pos AND f.service = s.service AND f.metric = s.metric WHERE s.value IS NOT NULL""",
    "monotone_ladder": f"""WITH {GRID},
crossed AS (
  SELECT *, list_sort([lag(value, 1) OVER w, lag(value, 4) OVER w, value, lag(value, 16) OVER w], 'ASC', 'NULLS LAST') AS q
  FROM grid WINDOW w AS ({W}))
SELECT timestamp, service, metric, {rungs_of("q", ["q1", "q2", "q3", "q4"])} FROM crossed WHERE value IS NOT NULL""",
    "pinball_loss": f"""WITH {GRID}, {NAIVE}
SELECT metric, {", ".join(f"{r(_loss('predicted', p))} AS loss_{round(p * 100)}" for p in (0.1, 0.5, 0.9))} FROM naive GROUP BY metric""",
    "coverage": f"""WITH {GRID}, {SIGMA},
inside AS (
  SELECT metric, CASE WHEN value IS NOT NULL AND mean IS NOT NULL AND std IS NOT NULL THEN
    CASE WHEN value >= mean - std * 2 AND value <= mean + std * 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS i FROM sigma)
SELECT metric, {r("avg(i)")} AS covered, count(i) AS usable FROM inside GROUP BY metric""",
    "pit_values": f"{PIT} SELECT timestamp, service, metric, clean, {r('pit')} AS pit FROM pits",
    "ks_pooled": f"{PIT}, {ks('pits')}",
    "ks_per_series": f"{PIT}, {ks('pits', 'service, metric')}",
    "tail_mass": f"""{PIT} SELECT {r("avg(CASE WHEN pit <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS below,
  {r("avg(CASE WHEN pit >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS above FROM pits""",
    "pit_histogram": f"{PIT}, {histogram('pits', 20)}",
    "accuracy_by_metric": f"""{SCORED},
spread AS (SELECT metric, CASE WHEN coalesce(stddev_pop(value), 0) = 0 THEN 1 ELSE stddev_pop(value) END AS spread FROM scored GROUP BY metric)
SELECT s.metric, {r("any_value(p.spread)")} AS spread, {", ".join(f"{r(f'{_loss(e, 0.5)} / any_value(p.spread)')} AS {n}" for n, e in _three.items())}
FROM scored s JOIN spread p ON p.metric = s.metric GROUP BY s.metric""",
    "accuracy_pooled": f"{SCORED} SELECT {', '.join(f'{r(_loss(e, 0.5))} AS {n}' for n, e in _three.items())} FROM scored",
    "calibration": f"""{PREDICTED} SELECT 0.9::DOUBLE AS nominal, {r(interval(2, 6, "clean"))} AS covered FROM predicted
UNION ALL SELECT 0.98::DOUBLE, {r(interval(1, 7, "clean"))} FROM predicted""",
    "separation": f"""{PREDICTED}
SELECT 0.9::DOUBLE AS nominal, {r(interval(2, 6, "clean"))} AS clean, {r(interval(2, 6, "NOT clean"))} AS anomalous FROM predicted
UNION ALL SELECT 0.98::DOUBLE, {r(interval(1, 7, "clean"))}, {r(interval(1, 7, "NOT clean"))} FROM predicted""",
    "honesty": f"""{PIT}, good AS (SELECT * FROM pits WHERE clean),
ends AS (
  SELECT avg(CASE WHEN pit <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS below,
    avg(CASE WHEN pit >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS above FROM good),
distance AS (WITH {ks("good")})
SELECT ks, n, {r("below")} AS below, {r("above")} AS above FROM distance CROSS JOIN ends""",
    "honesty_histogram": f"{PIT}, good AS (SELECT * FROM pits WHERE clean), {histogram('good', 10)}",
    "run_header": f"""{FULL},
marked AS (
  SELECT g.*, coalesce(NOT l.is_anomalous, false) AS clean FROM grid g LEFT JOIN labelled l
  ON l.timestamp = g.timestamp AND l.service = g.service AND l.metric = g.metric)
SELECT (SELECT count(*) FROM series) AS series, {STEP} AS step_seconds,
  min(CASE WHEN pos < {SPLIT} THEN timestamp END) AS train_start, max(CASE WHEN pos < {SPLIT} THEN timestamp END) AS train_end,
  count(CASE WHEN pos < {SPLIT} THEN 1 END) AS train_steps, min(CASE WHEN pos >= {SPLIT} THEN timestamp END) AS test_start,
  max(CASE WHEN pos >= {SPLIT} THEN timestamp END) AS test_end, count(CASE WHEN pos >= {SPLIT} THEN 1 END) AS test_steps,
  {r(f"(SELECT 1 - avg(CASE WHEN clean THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM marked WHERE pos >= {SPLIT})")} AS anomalous_share
FROM axis""",
    "edges": f"WITH RECURSIVE {EV}, {SERVICE_HOPS} SELECT caller, callee FROM calls",
    "dangling_edges": f"""WITH {USER_GRAPH}
SELECT caller, callee FROM links WHERE callee NOT IN (
  SELECT 'u' || user_id FROM events WHERE event_type = 'purchase' AND value > 100)""",
    "callers_of": f"WITH {USER_GRAPH} SELECT DISTINCT caller FROM links WHERE callee = 'u3'",
    "upstream_hops": f"""WITH RECURSIVE {USER_GRAPH},
walk(origin, service, hops) AS (
  SELECT callee, caller, 1 FROM links WHERE callee IN (SELECT 'u' || user_id FROM events WHERE event_type = 'error')
  UNION
  SELECT w.origin, c.caller, w.hops + 1 FROM walk w JOIN links c ON c.callee = w.service WHERE c.caller <> w.origin)
SELECT origin, service, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY origin, service""",
    "blast_radius": f"WITH RECURSIVE {EV}, {SERVICE_HOPS} SELECT root, affected_services FROM radius",
    "edge_drift": """WITH linked AS (
  SELECT DISTINCT 'u' || user_id AS caller, 'k' || json_extract_string(props, '$.k') AS callee, ts < TIMESTAMP '2024-01-16' AS early FROM events)
SELECT caller, callee, CASE WHEN bool_or(early) THEN 'described' ELSE 'observed' END AS side FROM linked
GROUP BY caller, callee HAVING count(*) = 1""",
    "affected_metrics": f"""WITH RECURSIVE {EV}, {FAULTS}
SELECT i.incident_id, i.kind, e.metric, e.at_caller FROM incidents i JOIN effects e ON e.kind = i.kind""",
    "affected_split": f"""WITH RECURSIVE {EV}, {FAULTS}, {CLAIMS}
SELECT incident_id, service, metric, start, finish AS "end" FROM claims""",
    "label_incidents": f"""WITH RECURSIVE {TEL}, {LABELLED}
SELECT timestamp, service, metric, {r("value")} AS value, is_anomalous, incident_id FROM labelled""",
    "onset_order": f"""WITH RECURSIVE {TEL}, {LABELLED}
SELECT incident_id, service, min(timestamp) AS onset FROM labelled WHERE is_anomalous GROUP BY incident_id, service""",
    "label_consistency": f"""WITH RECURSIVE {TEL}, {LABELLED},
damaged AS (
  SELECT incident_id || CASE WHEN ordinal % 7 = 5 THEN 'x' ELSE '' END AS incident_id,
    CASE WHEN ordinal % 7 = 6 THEN 'nowhere' ELSE root_service END AS root_service
  FROM incidents WHERE ordinal % 7 <> 3),
used AS (SELECT DISTINCT incident_id, service FROM labelled WHERE incident_id <> '')
SELECT DISTINCT incident_id, 'label without incident' AS problem FROM used WHERE incident_id NOT IN (SELECT incident_id FROM damaged)
UNION ALL SELECT incident_id, 'incident without label' FROM damaged WHERE incident_id NOT IN (SELECT incident_id FROM used)
UNION ALL SELECT i.incident_id, 'root not marked' FROM damaged i WHERE NOT EXISTS (
  SELECT 1 FROM used u WHERE u.incident_id = i.incident_id AND u.service = i.root_service)""",
    "incident_summary": f"""WITH RECURSIVE {EV}, {FAULTS}
SELECT kind, count(*) AS incidents, {r("avg(len(string_split(affected_services, ',')))")} AS mean_fan_out FROM incidents GROUP BY ROLLUP (kind)""",
    "run_manifest": f"""WITH RECURSIVE {GRID}, {LABELLED}
SELECT '0.1.0' AS package_version, min(timestamp) AS start, max(timestamp) AS "end", {STEP} AS step_seconds,
  count(DISTINCT service) AS services, (SELECT count(*) FROM series) AS series, count(*) AS rows,
  (SELECT count(*) FROM incidents) AS incidents,
  {r("avg(CASE WHEN is_anomalous THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS anomalous_fraction FROM labelled""",
    "fault_profile": f"""{WINDOWED}
SELECT w.ordinal, e.metric, u.i AS i, {r(factor("u.i"))} AS factor
FROM windows w JOIN effects e ON e.kind = w.kind, unnest(range(0, w.n)) AS u(i)""",
    "fault_propagation": f"""{SPREAD}
SELECT ordinal, service, metric, CAST(hops AS BIGINT) AS hops, CAST(from_pos AS BIGINT) AS from_pos, count(*) AS length, {r("max(peak)")} AS peak
FROM kept GROUP BY ordinal, service, metric, hops, from_pos""",
    "fault_overlay": f"{OVERLAID}, CASE WHEN g.value IS NOT NULL THEN {r(_bounded.format(v='g.value * coalesce(h.factor, 1)').replace('CASE metric', 'CASE g.metric'))} END AS value {_hit}",
    "fault_overlay_labels": f"""{OVERLAID}, coalesce(h.active, false) AS is_anomalous,
  coalesce(printf('INC-%04d', h.first), '') AS incident_id {_hit}""",
    "incident_records": f"""{SPREAD},
seen AS (
  SELECT ordinal, string_agg(DISTINCT service, ',' ORDER BY service) AS affected_services FROM kept k
  WHERE abs(factor - 1) > 0.05 AND EXISTS (SELECT 1 FROM series s WHERE s.service = k.service AND s.metric = k.metric) GROUP BY ordinal)
SELECT f.ordinal, printf('INC-%04d', f.ordinal) AS incident_id, f.kind, f.service AS root_service, f.start,
  CASE WHEN f.kind = 'deploy_regression' THEN (SELECT max(timestamp) FROM axis) ELSE f.finish END AS "end",
  {r("f.magnitude")} AS magnitude, f.kind = 'deploy_regression' AS permanent, coalesce(s.affected_services, '') AS affected_services
FROM faults f LEFT JOIN seen s ON s.ordinal = f.ordinal""",
    "fault_validate": f"""WITH RECURSIVE {EV}, {FAULTS}
SELECT ordinal, kind, 'magnitude must be above 0 and at most 1' AS problem FROM faults WHERE magnitude * 1.5 > 1
UNION ALL SELECT ordinal, kind, 'duration must be positive' FROM faults WHERE day(start) > 20""",
    "impact_report": f"""WITH RECURSIVE {TEL}, {SERVICE_HOPS},
sided AS (SELECT *, CASE WHEN timestamp < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS side FROM tel WHERE value IS NOT NULL),
med AS (SELECT service, metric, side, CAST(quantile_cont(value, 0.5) AS DOUBLE) AS median FROM sided GROUP BY ALL),
both_ AS (SELECT service FROM med GROUP BY service HAVING count(DISTINCT side) = 2),
b AS (
  SELECT b.service, {side("cpu_pct", "before")} AS cb, {side("cpu_pct", "after")} AS ca,
    {side("latency_p95_ms", "before")} AS pb, {side("latency_p95_ms", "after")} AS pa FROM both_ b)
SELECT b.service, CAST(CASE WHEN b.service = 's4' THEN 0 ELSE coalesce(h.hops, 99) END AS BIGINT) AS distance,
  {r("cb")} AS cpu_before, {r("ca")} AS cpu_after, {r("pb")} AS p95_before, {r("pa")} AS p95_after, {r("pa / nullif(pb, 0)")} AS p95_ratio
FROM b LEFT JOIN hops h ON h.origin = 's4' AND h.service = b.service""",
}

# what is written and read back is what went in
ORACLES["run_csv_round_trip"] = ORACLES["label_incidents"]
ORACLES["incidents_csv_round_trip"] = ORACLES["incidents_flat"]
ORACLES["manifest_json_round_trip"] = ORACLES["run_manifest"]
ORACLES["metric_subset"] = f"""WITH {TEL}
SELECT timestamp, service, metric, {r("value")} AS value FROM tel WHERE metric IN ('cpu_pct', 'mem_mb')"""
ORACLES["rejected_responses"] = f"""WITH {TEL},
pages AS (SELECT DISTINCT metric, service, CAST(timestamp AS DATE) AS day FROM tel WHERE value IS NOT NULL)
SELECT metric, CASE metric WHEN 'mem_mb' THEN 'too many samples' ELSE 'query failed' END AS error, count(*) AS responses
FROM pages WHERE metric IN ('mem_mb', 'error_rate') GROUP BY metric"""
ORACLES["service_filter"] = f"""{PREDICTED}
SELECT timestamp, service, metric, {r("value")} AS value, {rungs_of("q")} FROM predicted WHERE service IN ('s1', 's4')"""


def _unpivoted(section: str, query: str, item: str, columns: list[str]) -> str:
    """Columns of a report as rows of the long one."""
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""SELECT '{section}' AS section, item, name, value FROM (SELECT {item} AS item, {listed} FROM ({ORACLES[query]}))
  UNPIVOT INCLUDE NULLS (value FOR name IN ({", ".join(columns)}))"""


_seconds = ["train_start", "train_end", "test_start", "test_end"]
_header = ", ".join(f"epoch_us({c}) / CAST(1000000 AS DOUBLE) AS {c}" for c in _seconds)
ORACLES["_header_numbers"] = f"SELECT * REPLACE ({_header}) FROM ({ORACLES['run_header']})"
_share = "CASE WHEN nominal < 0.95 THEN '0.9' ELSE '0.98' END"
ORACLES["forecast_report"] = " UNION ALL ".join(
    [
        _unpivoted("accuracy", "accuracy_by_metric", "metric", ["spread", "forecaster", "seasonal", "ewma"]),
        _unpivoted("pooled", "accuracy_pooled", "''", ["forecaster", "seasonal", "ewma"]),
        _unpivoted("calibration", "calibration", _share, ["covered"]),
        _unpivoted("separation", "separation", _share, ["clean", "anomalous"]),
        _unpivoted("honesty", "honesty", "''", ["ks", "n", "below", "above"]),
        _unpivoted("histogram", "honesty_histogram", "CAST(bin AS VARCHAR)", ["observed", "ratio"]),
        _unpivoted("header", "_header_numbers", "''", ["series", "step_seconds", "train_steps", "test_steps", "anomalous_share", *_seconds]),
    ]
)
del ORACLES["_header_numbers"]


def _targets(target: str) -> str:
    """The scores of one target over two metrics' cells."""
    pits = PIT if target == "change" else PIT.replace(f"lag(value) OVER ({W}) AS anchor", "CAST(0 AS DOUBLE) AS anchor")
    chosen = "metric IN ('latency_p95_ms', 'mem_mb')"
    return f"""SELECT '{target}' AS target, * FROM ({pits},
mine AS (SELECT * FROM pits WHERE {chosen}),
distance AS (WITH {ks("mine")}),
scores AS (
  SELECT {r(_loss("q[4]", 0.5))} AS pinball, {r(interval(2, 6, "true"))} AS covered_90, {r(interval(1, 7, "true"))} AS covered_98
  FROM predicted WHERE {chosen}),
ends AS (
  SELECT {r("avg(CASE WHEN pit <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS below,
    {r("avg(CASE WHEN pit >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS above FROM mine)
SELECT * FROM scores CROSS JOIN distance CROSS JOIN ends)"""


ORACLES["target_comparison"] = f"{_targets('change')} UNION ALL {_targets('level')}"
