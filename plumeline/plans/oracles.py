"""The same results as plain SQL over the warehouse tables, for checking the queries."""

from __future__ import annotations

import re
from hashlib import md5

from plumeline.functions.process_tables import CATALYSTS, PATHWAYS, REACTORS, SELECTIVITY
from plumeline.operators import model, scoring, validation
from plumeline.operators.explore import OBJECTIVES
from plumeline.plans.queries import HORIZON, POLICY_YEARS, SCENARIOS, TOP
from plumeline.plans.tables import POINT_CATALYSTS, POINT_PATHWAYS, SECTORS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def number(value: float | None) -> str:
    return "NULL::DOUBLE" if value is None else f"{value!r}::DOUBLE"


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select


# Series

MONTH = "(year({d}) - 1995) * 12 + month({d})"
SITE_MONTHS = (
    f"s AS (SELECT l_suppkey AS k, {MONTH.format(d='l_shipdate')} AS t, sum(l_extendedprice / 997::DOUBLE) AS v "
    "FROM lineitem GROUP BY 1, 2)"
)
SITE_YEARS = (
    "s AS (SELECT l_suppkey AS k, year(l_shipdate) AS t, sum(l_extendedprice / 997::DOUBLE) AS v "
    "FROM lineitem GROUP BY 1, 2)"
)
NATION_MONTHS = (
    f"s AS (SELECT n_name AS k, {MONTH.format(d='o_orderdate')} AS t, sum(o_totalprice / 1e6) AS v "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
)


def frame(end: str) -> list[str]:
    """`f2`: history with positions and hold-out marks; `fx`: with future rows up to the period `end`."""
    return [
        """f0 AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY t) AS pos,
  count(*) OVER (PARTITION BY k) AS n, max(t) OVER (PARTITION BY k) AS last FROM s)""",
        "f1 AS (SELECT *, least(8, greatest(3, n // 6)) AS nt FROM f0)",
        "f2 AS (SELECT *, n >= nt + 5 AND pos <= n - nt AS train, n >= nt + 5 AND pos > n - nt AS test, TRUE AS hist FROM f1)",
        f"""fx AS (SELECT k, t, v, pos, n, nt, train, test, hist FROM f2 UNION ALL
  SELECT k, last + h, NULL, n + h, n, nt, FALSE, FALSE, FALSE
  FROM (SELECT k, last, n, nt, unnest(generate_series(1, {end} - last)) AS h FROM f2 WHERE t = last))""",
    ]


def poly(source: str, mark: str, degree: int, out: str, keys: str = "k") -> list[str]:
    """Orthogonal least squares; the last CTE `{out}` adds the column `{out}_fit` and `{out}_deg`."""
    w = f"OVER (PARTITION BY {keys})"
    on = f"FILTER (WHERE {mark})"
    ctes = [
        f"""{out}0 AS (SELECT *, t - sum(t::DOUBLE) {on} {w} / count(*) {on} {w} AS u, avg(v) {on} {w} AS fit,
  (count(*) {on} {w})::DOUBLE AS norm0, 0 AS deg FROM {source})""",
        f"{out}1p AS (SELECT *, u AS p, 1::DOUBLE AS prev FROM {out}0)",
    ]
    last = f"{out}1p"
    for d in range(1, degree + 1):
        ctes.append(
            f"{out}{d}s AS (SELECT *, sum(p * p) {on} {w} AS norm, sum(u * p * p) {on} {w} AS su, sum(v * p) {on} {w} AS sv FROM {last})"
        )
        last = f"{out}{d + 1}p"
        ctes.append(
            f"""{last} AS (SELECT * EXCLUDE (norm, su, sv, norm0, p, prev, fit, deg),
  CASE WHEN norm > 1e-6 THEN fit + sv / norm * p ELSE fit END AS fit,
  CASE WHEN norm > 1e-6 THEN (u - su / norm) * p - norm / norm0 * prev ELSE 0 END AS p,
  p AS prev, norm AS norm0, CASE WHEN norm > 1e-6 THEN {d} ELSE deg END AS deg FROM {out}{d}s)"""
        )
    ctes.append(f"{out} AS (SELECT * EXCLUDE (u, p, prev, norm0, fit, deg), fit AS {out}_fit, deg AS {out}_deg FROM {last})")
    return ctes


LAGS = [
    "l1 AS (SELECT *, lag(v, 1) OVER (PARTITION BY k ORDER BY t) AS y1, lag(v, 2) OVER (PARTITION BY k ORDER BY t) AS y2 FROM f2)",
    "l2 AS (SELECT *, v - y1 AS d1, y1 - y2 AS d2 FROM l1)",
]


def arima(mark: str, p: str) -> list[str]:
    """`{p}`: one row per series with the parameters and the chosen model."""
    models = {
        "mean": (2, "v - mean", "TRUE"),
        "random_walk": (1, "d1", "TRUE"),
        "random_walk_drift": (2, "d1 - drift", "TRUE"),
        "ar1": (3, "v - ar_c - ar * y1", "abs(ar) < 1 AND m >= 4"),
        "arima110": (3, "d1 - ari_c - ari * d2", "abs(ari) < 1 AND m >= 5"),
    }
    errors = ", ".join(f"sum(({e}) * ({e})) AS sse_{n}" for n, (_, e, _) in models.items())
    scores = " UNION ALL ".join(
        f"SELECT k, {i} AS rk, '{n}' AS model, round((m - 2) * ln(greatest(sse_{n} / (m - 2), 1e-12)) + 2.0 * {c}, 9) AS aic "
        f"FROM {p}_par JOIN {p}_sse USING (k) WHERE m > 2 AND {ok}"
        for i, (n, (c, _, ok)) in enumerate(models.items())
    )
    return [
        f"""{p}_par AS (SELECT k, count(*) AS m, avg(v) AS mean, arg_max(v, pos) AS last_y, arg_max(d1, pos) AS last_step,
  avg(d1) AS drift, regr_slope(v, y1) AS ar, regr_intercept(v, y1) AS ar_c, regr_slope(d1, d2) AS ari,
  regr_intercept(d1, d2) AS ari_c FROM l2 WHERE {mark} GROUP BY k)""",
        f"{p}_sse AS (SELECT k, {errors} FROM l2 JOIN {p}_par USING (k) WHERE {mark} AND pos >= 3 GROUP BY k)",
        f"{p}_aic AS ({scores})",
        f"""{p} AS (SELECT {p}_par.*, coalesce(b.model, 'random_walk') AS model FROM {p}_par LEFT JOIN
  (SELECT k, model FROM {p}_aic QUALIFY row_number() OVER (PARTITION BY k ORDER BY aic, rk) = 1) b USING (k))""",
    ]


def arima_value(p: str, h: str) -> str:
    g = "((1 - pow({f}, {h})) / (1 - {f}))"
    ar, ari = g.format(f=f"{p}.ar", h=h), g.format(f=f"{p}.ari", h=h)
    return f"""CASE {p}.model WHEN 'mean' THEN {p}.mean WHEN 'random_walk' THEN {p}.last_y
  WHEN 'random_walk_drift' THEN {p}.last_y + {h} * {p}.drift
  WHEN 'ar1' THEN pow({p}.ar, {h}) * {p}.last_y + {p}.ar_c * {ar}
  ELSE {p}.last_y + {p}.last_step * {p}.ari * {ari} + {p}.ari_c * (({h} - {p}.ari * {ari}) / (1 - {p}.ari)) END"""


def best(series: str, end: str, degree: int = 2) -> list[str]:
    """`fb`: future rows with the chosen forecast and both errors."""
    ape = "abs(v - {x}) / greatest(abs(v), 2.220446049250313e-16)"
    return [
        series,
        *frame(end),
        *LAGS,
        *arima("train", "art"),
        *arima("hist", "arf"),
        *poly("fx", "train", degree, "pt"),
        *poly("pt", "hist", degree, "pa"),
        f"""pair AS (SELECT pa.*, CASE WHEN test THEN {arima_value('art', '(pa.pos - (pa.n - pa.nt))')}
  WHEN NOT hist THEN {arima_value('arf', '(pa.pos - pa.n)')} END AS arima_pred, arf.model AS arima_model
  FROM pa LEFT JOIN art USING (k) JOIN arf USING (k))""",
        f"""err AS (SELECT k, any_value(n) AS n, any_value(nt) AS nt, avg({ape.format(x='pt_fit')}) FILTER (WHERE test) AS poly_mape,
  avg({ape.format(x='arima_pred')}) FILTER (WHERE test) AS arima_mape FROM pair GROUP BY k)""",
        f"""fb AS (SELECT k, t, CASE WHEN poly_mape < arima_mape THEN pa_fit ELSE arima_pred END AS forecast,
  CASE WHEN poly_mape < arima_mape THEN 'Poly(deg={degree})' ELSE 'ARIMA' END AS model, poly_mape, arima_mape, arima_pred, arima_model
  FROM pair JOIN err USING (k) WHERE NOT hist)""",
    ]


def series_queries() -> dict[str, str]:
    shown = "t, round(forecast, 6) AS forecast, model, round(poly_mape, 6) AS poly_mape, round(arima_mape, 6) AS arima_mape FROM fb"
    out = {
        "series_read_filter": query(
            [SITE_MONTHS],
            "SELECT k AS site, min(t) AS first_period, max(t) AS last_period, count(*) AS n_periods, "
            "round(arg_max(v, t), 6) AS last_value FROM s WHERE t BETWEEN 13 AND 72 GROUP BY k",
        ),
        "regions_distinct": "SELECT DISTINCT l_suppkey AS site FROM lineitem ORDER BY 1",
        "region_filter": query([NATION_MONTHS], "SELECT k AS n_name, t, round(v, 8) AS v FROM s WHERE substr(k, 8)::INT % 3 = 0"),
        "nation_forecast": query(best(NATION_MONTHS, f"last + {HORIZON}"), f"SELECT k AS n_name, {shown}"),
        "forecast_best": query(best(SITE_MONTHS, f"last + {HORIZON}"), f"SELECT k AS site, {shown}"),
        "forecast_guard_yearly": query(best(SITE_YEARS, "last + 5"), f"SELECT k AS site, {shown}"),
        "arima_closed_form": query(
            best(SITE_MONTHS, f"last + {HORIZON}", 1),
            "SELECT k AS site, t, arima_model AS model, round(arima_pred, 6) AS forecast FROM fb",
        ),
        "backtest_mape": query(
            best(SITE_MONTHS, "last"),
            "SELECT k AS site, n AS n_periods, nt AS n_test, round(poly_mape, 6) AS poly_mape, "
            "round(arima_mape, 6) AS arima_mape FROM err",
        ),
    }
    for d in (1, 2, 3, 4):
        out[f"poly_forecast_d{d}"] = query(
            [SITE_MONTHS, *frame(f"last + {HORIZON}"), *poly("fx", "hist", d, "pa")],
            "SELECT k AS site, t, round(pa_fit, 6) AS forecast, pa_deg AS effective_degree FROM pa WHERE NOT hist",
        )
    return out


# Scenarios


def scenario_ctes() -> list[str]:
    rows = ", ".join(
        f"({text(s['scenario'])}, {text(s['pathway'])}, {text(s['target_kind'])}, "
        f"{number(float(s.get('target_amount', 0.0)))}, {s['target_period']}, {len(s.get('milestones', {}))})"
        for s in SCENARIOS
    )
    stones = ", ".join(
        f"({text(s['scenario'])}, {t}, {number(v)})" for s in SCENARIOS for t, v in s.get("milestones", {}).items()
    )
    return [
        f"sc(scenario, pathway, kind, amount, tp, n_stones) AS (VALUES {rows})",
        f"stones(scenario, t, v) AS (VALUES {stones})",
        "span AS (SELECT k, max(t) AS start, arg_max(v, t) AS cur FROM s GROUP BY k)",
        """placed AS (SELECT *, CASE kind WHEN 'net_zero' THEN 0 WHEN 'percent' THEN cur * (1 - amount / 100) ELSE amount END AS target
  FROM span, sc WHERE tp > start)""",
    ]


SHAPES = {
    "linear": "cur + (target - cur) / (tp - start) * (t - start)",
    "exponential": "cur * exp(ln(CASE WHEN target <= 0 THEN 0.01 ELSE target END / cur) / (tp - start) * (t - start))",
    "scurve": "target + (cur - target) / (1 + exp(8.0::DOUBLE / (tp - start) * (t - (start + (tp - start) / 2.0::DOUBLE))))",
}

MILESTONE_FIT = [
    """mp AS (SELECT k, scenario, t, v, TRUE AS hist FROM placed JOIN s USING (k) WHERE pathway = 'milestones' AND n_stones > 0
  UNION ALL SELECT k, scenario, stones.t, stones.v, TRUE FROM placed JOIN stones USING (scenario) WHERE stones.t <> tp
  UNION ALL SELECT k, scenario, tp, target, TRUE FROM placed WHERE pathway = 'milestones' AND n_stones > 0
  UNION ALL SELECT k, scenario, unnest(generate_series(start + 1, tp)), NULL, FALSE FROM placed WHERE pathway = 'milestones' AND n_stones > 0)""",
    *poly("mp", "hist", 3, "ms", "k, scenario"),
]


def scenario_queries() -> dict[str, str]:
    out = {}
    for name, shape in SHAPES.items():
        out[f"pathway_{name}"] = query(
            [SITE_MONTHS, *scenario_ctes()],
            f"SELECT k AS site, scenario, t, round({shape}, 6) AS path FROM (SELECT *, unnest(generate_series(start + 1, tp)) AS t "
            f"FROM placed WHERE pathway = '{name}')",
        )
    out["pathway_milestones"] = query(
        [SITE_MONTHS, *scenario_ctes(), *MILESTONE_FIT],
        "SELECT k AS site, scenario, t, round(greatest(ms_fit, 0), 6) AS path FROM ms WHERE NOT hist",
    )
    furthest = max(s["target_period"] for s in SCENARIOS)
    paths = [
        *best(SITE_MONTHS, str(furthest)),
        *scenario_ctes(),
        *MILESTONE_FIT,
        f"""sp AS (SELECT placed.*, fb.t, fb.forecast AS bau, fb.model, greatest(0, CASE pathway WHEN 'linear' THEN {SHAPES['linear']}
  WHEN 'scurve' THEN {SHAPES['scurve']} ELSE coalesce(ms_fit, {SHAPES['exponential']}) END) AS com
  FROM fb JOIN placed ON placed.k = fb.k AND fb.t <= tp
  LEFT JOIN (SELECT k, scenario, t, ms_fit FROM ms WHERE NOT hist) ms ON ms.k = fb.k AND ms.t = fb.t AND ms.scenario = placed.scenario)""".replace(
            "(t - ", "(fb.t - "
        ),
    ]
    out["scenario_gap"] = query(
        paths,
        "SELECT k AS site, scenario, pathway, t, round(bau, 6) AS bau, round(com, 6) AS commitment, round(bau - com, 6) AS gap, model FROM sp",
    )
    out["scenario_summary"] = query(
        paths,
        "SELECT k AS site, scenario, pathway, round(max(cur), 6) AS current, round(max(target), 6) AS target, "
        "round(sum(bau - com), 6) AS total_gap, round(sum(bau - com) / count(*), 6) AS mean_yearly_gap, "
        "round((max(cur) - max(target)) / max(cur) * 100, 6) AS reduction_pct FROM sp GROUP BY ALL",
    )
    out["scenario_rejects"] = query(
        [SITE_MONTHS, *scenario_ctes()],
        "SELECT k AS site, scenario, 'Target year must be > ' || start AS reason FROM span, sc WHERE tp <= start",
    )
    return out


# Policies

SECTOR_POS = "CASE sector " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SECTORS, 1)) + " END"
POLICY = [
    """yearly AS (SELECT l_suppkey AS site, l_returnflag || l_linestatus AS sector, year(l_shipdate) AS y,
  sum(l_quantity) AS q, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL)""",
    f"""a0 AS (SELECT site, sector, {SECTOR_POS} AS pos, sum(value) AS value, sum(q) FILTER (WHERE y >= 1996) AS total_q,
  count(*) FILTER (WHERE y >= 1996) AS n_knots FROM yearly GROUP BY ALL)""",
    """acts AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sector) - 1 AS action_idx,
  CASE WHEN sector = 'NO' THEN -value ELSE value END / 9973 AS base,
  CASE WHEN site % 5 = 0 THEN 20::DOUBLE END AS manual,
  CASE (site + pos) % 4 WHEN 0 THEN 0::DOUBLE WHEN 2 THEN 30::DOUBLE WHEN 3 THEN 90::DOUBLE END AS red,
  CASE WHEN sector = 'NO' AND site % 3 = 0 THEN 120::DOUBLE END AS rem,
  CASE pos % 3 WHEN 0 THEN 'On track' WHEN 1 THEN 'Behind schedule' ELSE 'Ahead' END AS status FROM a0)""",
    """sites AS (SELECT site, sum(value) / 9999991 AS base_gt, CASE WHEN site % 3 = 0 THEN 'forecast' ELSE 'target' END AS mode,
  CASE WHEN site % 3 <> 0 THEN (40 + site % 5 * 10)::DOUBLE END AS cut FROM a0 GROUP BY site)""",
    """knots AS (SELECT site, sector, y, sum(q) OVER (PARTITION BY site, sector ORDER BY y) / total_q * 40 AS p
  FROM yearly JOIN a0 USING (site, sector) WHERE y >= 1996)""",
    """tgt AS (SELECT *, CASE WHEN base < 0 THEN coalesce(rem, red) ELSE coalesce(red, rem) END AS target_pct,
  sum(CASE WHEN base > 0 THEN base END) OVER (PARTITION BY site) AS gross FROM acts)""",
    """shares AS (SELECT *, coalesce(manual, CASE WHEN base > 0 THEN base / gross * 100 ELSE 0 END) AS share FROM tgt)""",
]


def reduction_ctes(start: int, end: int) -> list[str]:
    """`red`: reduction per action and year, with (`pct`) and without (`pct_free`) the target year."""
    toward = "least(e.p + (target_pct - e.p) / {span} * (year - e.y), target_pct)"
    value = """CASE WHEN year < 1995 OR e.y IS NULL OR year < e.y0 THEN 0
  WHEN year <= e.y THEN kb.p + coalesce((kn.p - kb.p) * (year - kb.y) / (kn.y - kb.y)::DOUBLE, 0)
  WHEN target_pct IS NULL OR target_pct = 0 THEN CASE WHEN e.n >= 2
    THEN least(greatest(e.p + e.slope * (year - e.y) / (1 + 0.05::DOUBLE * (year - e.y)), 0), 150) ELSE e.p END
  WHEN e.p >= target_pct THEN target_pct ELSE {toward} END"""
    free = "greatest(10, e.y - e.y0)"
    aimed = f"(CASE WHEN 2030 > e.y THEN 2030 - e.y ELSE {free} END)"
    return [
        "e AS (SELECT site, sector, count(*) AS n, min(y) AS y0, max(y) AS y, arg_max(p, y) AS p, regr_slope(p, y) AS slope FROM knots GROUP BY ALL)",
        "nxt AS (SELECT *, lead(y) OVER (PARTITION BY site, sector ORDER BY y) AS y2, lead(p) OVER (PARTITION BY site, sector ORDER BY y) AS p2 FROM knots)",
        f"ay AS (SELECT *, unnest(generate_series({start}, {end})) AS year FROM shares)",
        f"""red AS (SELECT ay.*, {value.format(toward=toward.format(span=aimed))} AS pct,
  {value.format(toward=toward.format(span=free))} AS pct_free
  FROM ay LEFT JOIN e USING (site, sector)
  LEFT JOIN (SELECT site, sector, y, p, y2, p2 FROM nxt) kb ON kb.site = ay.site AND kb.sector = ay.sector AND kb.y <= year AND (kb.y2 IS NULL OR year < kb.y2)
  LEFT JOIN (SELECT site, sector, y, p FROM knots) kn ON kn.site = ay.site AND kn.sector = ay.sector AND kn.y = kb.y2)""",
    ]


FRACTION = """frac AS (SELECT site, year, least(coalesce(sum(CASE WHEN base > 0 THEN share / 100 * pct / 100 END), 0)
  + coalesce(sum(CASE WHEN base < 0 THEN abs(base) * pct / 100 / (base_gt * 1000) END), 0), 1) AS fraction
  FROM red JOIN sites USING (site) GROUP BY ALL)"""


def policy_queries() -> dict[str, str]:
    years = reduction_ctes(*POLICY_YEARS)
    named = "'Country ''SITE_' || site || ''' "
    fields = ["country", "target_year", "baseline_year", "baseline_emissions_gtco2", "policy_actions"]
    assert fields == validation.COUNTRY_FIELDS
    documents = f"""v AS (
  SELECT site, -1 AS country_pos, -1 AS action_idx, 0 AS rule_no, 'Invalid JSON syntax' AS message FROM sites WHERE site % 9 = 4
  UNION ALL SELECT site, -1, -1, 0, 'JSON must be an object with country names as keys' FROM sites WHERE site % 9 = 7
  UNION ALL SELECT site, 0, -1, 3, {named}missing required field: baseline_year' FROM sites WHERE site % 9 = 1
  UNION ALL SELECT site, 0, -1, 7, {named}has invalid mode ''goal'' (must be ''forecast'' or ''target'')' FROM sites WHERE site % 9 = 2
  UNION ALL SELECT site, 0, action_idx, 18, {named}action ' || action_idx || ' (' || sector || '): implementation_years and yearly_improvement_pct must have same length' FROM acts WHERE site % 9 = 3 AND n_knots > 0
  UNION ALL SELECT site, 0, action_idx, 15, {named}action ' || action_idx || ' missing field: status' FROM acts WHERE site % 9 = 5
  UNION ALL SELECT site, 0, action_idx, 16, {named}action ' || action_idx || ' (' || sector || '): must have either ''reduction_target_pct'' or ''removal_increase_pct''' FROM acts WHERE site % 9 = 6 AND red IS NULL AND rem IS NULL
  UNION ALL SELECT site, 0, action_idx, 17, {named}action ' || action_idx || ' (' || sector || '): sink sectors should use ''removal_increase_pct'' instead of ''reduction_target_pct''' FROM acts WHERE site % 9 = 6 AND sector = 'NO' AND rem IS NULL
  UNION ALL SELECT site, 1, -1, rule_no, message FROM sites, (VALUES {', '.join(f"({i}, 'Country ''_comments'' missing required field: {f}')" for i, f in enumerate(fields, 1))},
    (6, 'Country ''_comments'' in target mode must have ''target_reduction_pct''')) r(rule_no, message) WHERE site % 9 = 8)"""
    smooth = "list_reduce(list_transform(vs, lambda x: [x]), lambda acc, x: list_append(acc, CASE WHEN x[1] > acc[-1] THEN acc[-1] * 0.995::DOUBLE ELSE x[1] END))"
    path = [
        *best(SITE_YEARS, "2030"),
        *POLICY,
        *reduction_ctes(1996, 2030),
        FRACTION,
        "ends AS (SELECT k AS site, arg_max(v, t) AS cur FROM s GROUP BY k)",
        "pl AS (SELECT site, cur, cut IS NULL AS free, base_gt * (9999991::DOUBLE / 997 / 7) * (1 - CASE WHEN cut IS NULL THEN fraction ELSE cut / 100 END) AS target "
        "FROM ends JOIN sites USING (site) JOIN frac USING (site) WHERE frac.year = 2030)",
        """raw AS (SELECT site, fb.t, fb.forecast AS bau, target, free,
  least(CASE WHEN free THEN cur * (1 - fraction) ELSE greatest(cur * (1 - fraction), target) END, fb.forecast) AS v
  FROM fb JOIN pl ON pl.site = fb.k JOIN frac USING (site) WHERE frac.year = fb.t)""",
        "lists AS (SELECT site, list(t ORDER BY t) AS ts, list(v ORDER BY t) AS vs FROM raw GROUP BY site)",
        f"walk AS (SELECT site, unnest(ts) AS t, unnest({smooth}) AS v FROM lists)",
        """pp AS (SELECT site, t, bau, target, greatest(CASE WHEN NOT free AND t = 2030 THEN target ELSE walk.v END, 0) AS com
  FROM walk JOIN raw USING (site, t))""",
    ]
    return {
        "commitments_parse": query(
            POLICY,
            "SELECT site, unnest(['SITE_' || site, 'TWIN_' || site]) AS entry, action_idx, sector, 'Programme ' || sector AS action_name, round(base, 6) AS baseline_emissions_mtco2, "
            "manual AS manual_share_pct, red AS reduction_target_pct, rem AS removal_increase_pct, n_knots, status FROM acts",
        ),
        "commitments_countries": query(
            POLICY,
            "SELECT site, 0 AS country_pos, 'SITE_' || site AS entry FROM sites WHERE site % 9 NOT IN (4, 7) "
            "UNION ALL SELECT site, 1, '_comments' FROM sites WHERE site % 9 = 8",
        ),
        "commitment_targets": query(
            POLICY,
            "SELECT site, 'SITE_' || site AS entry, mode, cut IS NULL AS forecast_mode, 2030 AS target_year, "
            "round(base_gt * (1 - coalesce(cut, 0) / 100), 6) AS target_emissions_gtco2 FROM sites "
            "UNION ALL SELECT site, 'TWIN_' || site, mode, cut IS NULL, 2030, round(base_gt / 2 * (1 - coalesce(cut, 0) / 100), 6) FROM sites",
        ),
        "commitments_validate": query(
            [*POLICY, documents],
            "SELECT sites.site, count(rule_no) = 0 AS is_valid, count(rule_no) AS n_violations, "
            "coalesce(arg_min(rule_no, [country_pos, action_idx, rule_no]), -1) AS first_rule, "
            f"coalesce(arg_min(message, [country_pos, action_idx, rule_no]), {text(validation.VALID)}) AS message "
            "FROM sites LEFT JOIN v USING (site) GROUP BY 1",
        ),
        "commitment_violations": query(
            [*POLICY, documents], "SELECT rule_no, count(*) AS n_violations, min(site) AS first_site FROM v GROUP BY 1"
        ),
        "mode_mismatch": query(POLICY, "SELECT site, unnest(['SITE_' || site, 'TWIN_' || site]) AS entry, mode FROM sites WHERE mode <> 'target'"),
        "unsorted_years": query(POLICY, "SELECT site, action_idx, sector FROM acts WHERE site % 10 = 7 AND n_knots > 1"),
        "sector_share": query(POLICY, "SELECT site, sector, round(share, 6) AS share_pct FROM shares"),
        "share_quality": query(
            POLICY, "SELECT site, round(sum(share), 6) AS share_sum, count(manual) AS manual_shares FROM shares GROUP BY 1"
        ),
        "sector_breakdown": query(POLICY, "SELECT site, sector, round(sum(base), 6) AS baseline_mtco2 FROM acts GROUP BY 1, 2"),
        "sector_contributions": query(
            POLICY,
            "SELECT site, sector, round(coalesce(sum(base * target_pct / 100), 0), 6) AS contribution_mtco2 FROM tgt GROUP BY 1, 2",
        ),
        "reduction_by_year": query([*POLICY, *years], "SELECT site, sector, year, round(pct, 6) AS reduction_pct FROM red"),
        "reduction_by_year_rows": query([*POLICY, *years], "SELECT site, sector, year, round(pct, 6) AS reduction_pct FROM red"),
        "discount_asof": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS site, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INTEGER AS day, l_discount, l_returnflag FROM lineitem),
k AS (SELECT site, day, avg(l_discount * 100) AS pct FROM l GROUP BY ALL),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, site, day + 45 AS day FROM l WHERE l_returnflag = 'R')
SELECT q.*, b.day AS day_before, a.day AS day_after, round(b.pct + coalesce((a.pct - b.pct) * (q.day - b.day) / (a.day - b.day), 0), 6) AS pct
FROM q ASOF LEFT JOIN k b ON q.site = b.site AND q.day >= b.day ASOF LEFT JOIN k a ON q.site = a.site AND q.day < a.day""",
        "absolute_reduction": query(
            [*POLICY, *years], "SELECT site, sector, year, round(base * pct_free / 100, 6) AS absolute_reduction_mtco2 FROM red"
        ),
        "annual_fraction": query([*POLICY, *years, FRACTION], "SELECT site, year, round(fraction, 6) AS fraction FROM frac"),
        "data_gap": query(
            POLICY,
            "SELECT site, 2030 AS target_year, max(y) AS last_data_year, 2030 - max(y) AS gap_years, "
            "CASE WHEN 2030 - max(y) > 5 THEN 'large' WHEN 2030 - max(y) > 0 THEN 'small' ELSE 'none' END AS gap_class FROM knots GROUP BY 1",
        ),
        "sector_progress": query(
            POLICY,
            "SELECT site, sector, target_pct, y AS year, round(p, 6) AS progress_pct, "
            "round(p - lag(p) OVER (PARTITION BY site, sector ORDER BY y), 6) AS change_pct FROM knots JOIN tgt USING (site, sector)",
        ),
        "sector_report": query(
            [*POLICY, "lg AS (SELECT *, lag(p) OVER (PARTITION BY site, sector ORDER BY y) AS p0 FROM knots)"],
            "SELECT site, sector, status, round(base, 6) AS baseline_emissions_mtco2, round(share, 6) AS share_pct, target_pct, "
            "CASE WHEN base < 0 THEN 'Removal Increase' ELSE 'Reduction Target' END AS target_label, max(y) AS progress_year, "
            "round(arg_max(p, y), 6) AS progress_pct, round(arg_max(p - p0, y), 6) AS yearly_change_pct "
            "FROM shares LEFT JOIN lg USING (site, sector) GROUP BY ALL",
        ),
        "policy_pathway": query(
            path, "SELECT site, t, round(bau, 6) AS bau, round(com, 6) AS commitment, round(bau - com, 6) AS gap, round(target, 6) AS target FROM pp"
        ),
        "scenario_policy": query(
            [*path, """straight AS (SELECT fb.k AS site, fb.t, fb.forecast AS bau,
  greatest(0, v0 - v0 * (fb.t - t0)::DOUBLE / (2030 - t0)) AS com
  FROM fb JOIN (SELECT k, max(t) AS t0, arg_max(v, t) AS v0 FROM s GROUP BY k) USING (k) WHERE fb.t <= 2030)"""],
            "SELECT site, 'policies' AS scenario, t, round(bau, 6) AS bau, round(com, 6) AS commitment, round(bau - com, 6) AS gap FROM pp "
            "UNION ALL SELECT site, 'straight', t, round(bau, 6), round(com, 6), round(bau - com, 6) FROM straight",
        ),
        "annual_fraction_entries": query(
            [*POLICY, *years, FRACTION, "half AS (SELECT * REPLACE (base_gt / 2 AS base_gt) FROM sites)", FRACTION.replace("frac AS", "twin AS").replace("JOIN sites", "JOIN half")],
            "SELECT site, 'SITE_' || site AS entry, year, round(fraction, 6) AS fraction FROM frac "
            "UNION ALL SELECT site, 'TWIN_' || site, year, round(fraction, 6) FROM twin",
        ),
    }


# Process points


def pick(expr: str, names: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {text(n)}" for i, n in enumerate(names)) + " END"


REACTOR = "CASE l_returnflag WHEN 'A' THEN 'Fixed-bed' WHEN 'N' THEN 'Slurry' ELSE 'Electrochemical (flow cell)' END"
POINTS = f"""points AS (SELECT l_orderkey, l_linenumber, l_partkey, {pick('l_partkey % 6', POINT_PATHWAYS)} AS pathway,
  {pick('l_partkey % 7', POINT_CATALYSTS)} AS catalyst, 20 + 8 * l_quantity AS temp, 1 + 500 * l_discount AS press,
  1 + 50 * l_tax AS h2, {REACTOR} AS reactor, (18 * (l_suppkey % 50))::DOUBLE AS grid FROM lineitem)"""
SHORT = {"CH4": "ch4", "CO": "co", "CH3OH": "ch3oh", "C5+": "c5p", "HCOO/HCOOH": "hcoo"}


def scored(source: str) -> list[str]:
    """`sc`: the rows of `source` with every score column."""
    pathways = ", ".join(
        f"({i}, {text(r[0])}, {text(r[1])}, {', '.join(number(float(x)) for x in r[2:])})" for i, r in enumerate(PATHWAYS)
    )
    catalysts = ", ".join(f"({i}, {text(n)}, {number(g)})" for i, (n, g) in enumerate(CATALYSTS))
    reactors = ", ".join(f"({text(n)}, {number(b)})" for n, b in REACTORS)
    mix = {}
    for product, short in SHORT.items():
        cases = " ".join(
            f"WHEN {text(r[0])} THEN {number(r[2])} + {number(r[3])} * st + {number(r[4])} * (1 - st) + {number(r[5])} * sh"
            for r in SELECTIVITY
            if r[1] == product
        )
        mix[short] = f"CASE pathway {cases} END AS r_{short}"
    shorts = list(SHORT.values())
    total = " + ".join(f"coalesce(m_{s}, 0)" for s in [*shorts, "others"])
    clip = "CASE WHEN r_{s} IS NOT NULL THEN greatest(least(r_{s}, 1), 0) END AS m_{s}"
    return [
        f"pw(pathway_pos, pathway, product, byield, stoich, t0, tw, p0, pw, h0, hw) AS (VALUES {pathways})",
        f"cw(catalyst_pos, catalyst, gain) AS (VALUES {catalysts})",
        f"rw(reactor, bias) AS (VALUES {reactors})",
        f"""c0 AS (SELECT q.*, coalesce(pathway_pos, -1) AS pathway_pos, coalesce(catalyst_pos, -1) AS catalyst_pos,
  coalesce(product, 'Unknown') AS product, coalesce(byield, 0.4::DOUBLE) AS byield, coalesce(stoich, 2) AS stoich, coalesce(t0, 300) AS t0,
  coalesce(tw, 60) AS tw, coalesce(p0, 10) AS p0, coalesce(pw, 8) AS pw, coalesce(h0, 2) AS h0, coalesce(hw, 1) AS hw,
  coalesce(gain, 1) AS gain, coalesce(bias, 1) AS bias, q.pathway LIKE '%Electro%' AS electro
  FROM {source} q LEFT JOIN pw ON pw.pathway = q.pathway LEFT JOIN cw ON cw.catalyst = q.catalyst LEFT JOIN rw ON rw.reactor = q.reactor)""",
        """c1 AS (SELECT *, exp(-pow(temp - t0, 2) / (2 * pow(greatest(10, tw / 2), 2))) AS st,
  exp(-pow(press - p0, 2) / (2 * pow(greatest(2, pw / 2), 2))) AS sp,
  exp(-pow(h2 - h0, 2) / (2 * pow(greatest(0.4::DOUBLE, hw / 2), 2))) AS sh FROM c0)""",
        f"c2 AS (SELECT *, {', '.join(mix.values())} FROM c1)",
        f"c3 AS (SELECT *, 1 - ({' + '.join(f'coalesce(r_{s}, 0)' for s in shorts)}) AS r_others FROM c2)",
        f"c4 AS (SELECT *, {', '.join(clip.format(s=s) for s in [*shorts, 'others'])} FROM c3)",
        f"c5 AS (SELECT *, {total} AS msum FROM c4)",
        """c6 AS (SELECT *, greatest(0.03::DOUBLE, least(0.95::DOUBLE,
  greatest(0.05::DOUBLE, least(0.95::DOUBLE, byield * gain * bias * (0.5::DOUBLE + 0.5::DOUBLE * st) * (0.6::DOUBLE + 0.4::DOUBLE * sp) * (0.5::DOUBLE + 0.5::DOUBLE * sh)))
  * (CASE WHEN electro AND grid > 600 THEN 0.9::DOUBLE WHEN electro AND grid < 100 THEN 1.03::DOUBLE ELSE 1 END)
  * (0.8::DOUBLE + 0.2::DOUBLE * least(1, (h2 + 1e-9) / stoich)))) AS yld FROM c5)""",
        f"""sc AS (SELECT *, round(100 * yld, 1) AS yield_pct, greatest(3, round(round(100 * yld, 1) - 7, 1)) AS yield_low,
  least(95, round(round(100 * yld, 1) + 7, 1)) AS yield_high,
  round(100 * greatest(0.02::DOUBLE, least(0.98::DOUBLE, yld * (0.8::DOUBLE + 0.2::DOUBLE * (1 - m_others / msum)))), 1) AS carbon_util_pct,
  round(st, 3) AS temperature_score, round(sp, 3) AS pressure_score, round(sh, 3) AS h2_score,
  {', '.join(f'round(100 * (m_{s} / msum), 1) AS sel_{s}' for s in [*shorts, 'others'])} FROM c6)""",
    ]


OP_SCORE = "round((temperature_score + pressure_score + h2_score) / 3, 3)"
RANGE = "printf('%.1f', yield_low) || '–' || printf('%.1f', yield_high) || '%'"
VALID_PAIR = (
    "CASE WHEN pathway LIKE '%Electro%' THEN catalyst IN ("
    + ", ".join(text(c) for c in scoring.ELECTRO_CATALYSTS)
    + ") ELSE catalyst IN ("
    + ", ".join(text(c) for c in scoring.THERMAL_CATALYSTS)
    + ") END"
)
CELLS = f"cells AS (SELECT pathway, pathway_pos, catalyst, catalyst_pos, product, max(yield_pct) AS y FROM sc WHERE {VALID_PAIR} GROUP BY ALL)"
CONDITIONS = """cond AS (SELECT cells.pathway, cells.pathway_pos, trunc(t0)::INT || '±' || trunc(tw / 2)::INT AS temperature_range,
  trunc(p0)::INT || '±' || trunc(pw.pw / 2)::INT AS pressure_range,
  printf('%.1f', h0) || '±' || printf('%.1f', hw / 2) AS h2_ratio_range, catalyst AS best_catalyst, y AS max_yield, cells.product AS primary_product
  FROM (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY pathway ORDER BY y DESC, catalyst_pos) = 1) cells
  JOIN pw ON pw.pathway = cells.pathway)"""
UNITS = f"""u0 AS (SELECT l_partkey AS unit, pathway, catalyst, max(reactor) AS reactor, min(temp) AS t_min, max(temp) AS t_max,
  min(press) AS p_min, max(press) AS p_max, min(h2) AS h_min, max(h2) AS h_max FROM points GROUP BY ALL)"""
GRID = """gp AS (SELECT unit, pathway, catalyst, reactor, (18 * (unit % 50))::DOUBLE AS grid, i AS t_index, j AS p_index, l AS h_index,
  t_min + i * ((t_max - t_min) / 6) AS temp, p_min + j * ((p_max - p_min) / 6) AS press, h_min + l * ((h_max - h_min) / 6) AS h2
  FROM u0, range(7) a(i), range(7) b(j), range(7) c(l))"""


def grid_select(objective: str) -> str:
    column = OBJECTIVES[objective]
    products = ", ".join(f"coalesce(sel_{s}, 0) AS sel_{s}" for s in SHORT.values())
    return f"""g AS (SELECT unit, t_index, p_index, h_index, round(temp, 3) AS temperature_c, round(press, 3) AS pressure_bar,
  round(h2, 3) AS h2_to_co2, yield_pct, {RANGE} AS yield_range, product AS primary_product, carbon_util_pct, {products},
  coalesce({column}, 0) AS objective_score FROM sc)"""


def process_queries() -> dict[str, str]:
    base = [POINTS, *scored("points")]
    grid = [POINTS, UNITS, GRID, *scored("gp"), grid_select("Maximize yield")]
    order = "ORDER BY objective_score DESC, t_index, p_index, h_index"
    slate = " UNION ALL ".join(
        f"SELECT pathway, {text(n)} AS product, sel_{s} AS x FROM sc WHERE sel_{s} IS NOT NULL"
        for n, s in [*SHORT.items(), ("others", "others")]
    )
    suggestions = f"""CASE WHEN st < 0.5 THEN 'Increase temperature toward ~' || trunc(t0)::INT || '°C (±' || trunc(tw / 2)::INT || '°C).' END,
  CASE WHEN sp < 0.5 AND NOT electro THEN 'Increase pressure toward ~' || trunc(p0)::INT || ' bar (±' || trunc(pw / 2)::INT || ' bar).' END,
  CASE WHEN sh < 0.5 THEN 'Adjust H₂:CO₂ toward ~' || printf('%.1f', h0) || ':1 (±' || printf('%.1f', hw / 2) || ').' END,
  CASE WHEN electro AND grid > 400 THEN {text(scoring.CLEANER)} END"""
    notes = f"""CASE WHEN electro AND grid > 600 THEN {text(scoring.HIGH_GRID_NOTE)} END,
  CASE WHEN electro AND grid < 100 THEN {text(scoring.LOW_GRID_NOTE)} END"""
    kept = "list_filter([{x}], lambda m: m IS NOT NULL)"
    lists = (
        f"msg AS (SELECT pathway, {kept.format(x=suggestions)} AS sg, {kept.format(x=notes)} AS nt FROM sc)"
    )
    said = f"""said AS (SELECT pathway, 'suggestion' AS kind, unnest(CASE WHEN len(sg) = 0 THEN [{text(scoring.NOMINAL)}] ELSE sg END) AS message FROM msg
  UNION ALL SELECT pathway, 'note', unnest(CASE WHEN len(nt) = 0 THEN [{text(scoring.DEFAULT_NOTE)}] ELSE nt END) FROM msg)"""
    names = dict(zip(["ni", "cu_zno", "fe_co", "ag_au", "cu_electro", "other"], [c for c, _ in CATALYSTS], strict=True))
    cols = ", ".join(f"max(y) FILTER (WHERE catalyst = {text(c)}) AS {n}" for n, c in names.items())
    ends = "SELECT '{w}' AS which, pathway, max_yield, best_catalyst, primary_product FROM cond QUALIFY row_number() OVER (ORDER BY max_yield {d}, pathway_pos) = 1"
    distance = f"""(CASE WHEN temp < 170 THEN (170 - temp) / 170 WHEN temp > 240 THEN (temp - 240) / 240 ELSE 0 END
  + CASE WHEN press < 1 THEN {number(model.LOW_PRESSURE_DISTANCE)} WHEN press > 50 THEN (press - 50) / 50 ELSE 0 END
  + CASE WHEN h2 < 1 OR h2 > 4 THEN least(abs(h2 - 1), abs(h2 - 4)) / 4 ELSE 0 END)"""
    return {
        "score_points": query(
            base,
            f"SELECT l_orderkey, l_linenumber, l_partkey, product AS primary_product, yield_pct, {RANGE} AS yield_range, "
            f"round(stoich, 2) AS h2_per_co2, carbon_util_pct, temperature_score, pressure_score, h2_score, {OP_SCORE} AS operating_score FROM sc",
        ),
        "product_slate": query(
            [*base, f"sl AS ({slate})"],
            "SELECT pathway, product, count(*) AS n_points, round(avg(x), 6) AS mean_pct, round(max(x), 6) AS max_pct FROM sl GROUP BY 1, 2",
        ),
        "operating_score": query(
            base, f"SELECT pathway, round(avg({OP_SCORE}), 6) AS mean_score, max({OP_SCORE}) AS best_score FROM sc GROUP BY 1"
        ),
        "point_messages": query([*base, lists, said], "SELECT pathway, kind, message, count(*) AS n_points FROM said GROUP BY 1, 2, 3"),
        "catalyst_matrix": query([*base, CELLS], f"SELECT pathway, {cols} FROM cells WHERE pathway_pos >= 0 GROUP BY 1"),
        "matrix_summary": query(
            [*base, CELLS],
            "SELECT arg_min(pathway, [-y, catalyst_pos, pathway_pos]) AS best_pathway, arg_min(catalyst, [-y, catalyst_pos, pathway_pos]) AS best_catalyst, "
            "max(y) AS best_yield, round(avg(y), 6) AS mean_yield, count(*) AS valid_cells, 30 AS total_cells FROM cells WHERE pathway_pos >= 0 AND catalyst_pos >= 0",
        ),
        "optimal_conditions": query([*base, CELLS, CONDITIONS], "SELECT * EXCLUDE (pathway_pos) FROM cond"),
        "conditions_extremes": query(
            [*base, CELLS, CONDITIONS],
            f"({ends.format(w='highest', d='DESC')}) UNION ALL ({ends.format(w='lowest', d='ASC')})",
        ),
        "grid_search_top10": query(grid, f"SELECT * FROM g {order}, unit LIMIT 10"),
        "grid_best_per_unit": query(
            grid,
            f"SELECT unit, rank, t_index, p_index, h_index, yield_pct, carbon_util_pct, objective_score FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY unit {order}) AS rank FROM g) WHERE rank <= {TOP}",
        ),
        "grid_objectives": query(
            grid,
            "SELECT primary_product, max(yield_pct) AS yield_pct, "
            + ", ".join(f"max(sel_{s}) AS sel_{s}" for s in SHORT.values())
            + " FROM g GROUP BY 1",
        ),
        "grid_selectivity_top10": query(
            [POINTS, UNITS, GRID, *scored("gp"), grid_select("Maximize CH3OH selectivity")],
            f"SELECT unit, t_index, p_index, h_index, sel_ch3oh, objective_score FROM g {order}, unit LIMIT 10",
        ),
        "grid_heatmap": query(
            grid,
            "SELECT unit, t_index, temperature_c, "
            + ", ".join(f"max(yield_pct) FILTER (WHERE p_index = {i}) AS p_{i}" for i in range(7))
            + " FROM g WHERE h_index = 3 GROUP BY 1, 2, 3",
        ),
        "confidence": query(
            [POINTS],
            f"SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(exp(-3 * {distance} / 3), 1), 0), 6) AS confidence FROM points",
        ),
        "route_rules": query(
            base,
            f"SELECT {text(model.RULE_NAME)} AS model_used, {text(model.RULE_CONFIDENCE)} AS data_confidence, pathway, "
            "count(*) AS n_points, round(avg(yield_pct), 6) AS mean_yield FROM sc GROUP BY pathway",
        ),
    }


# Training table

NAMES = [r[0] for r in PATHWAYS]
RUNS = f"""runs AS (
  SELECT 'Methanol synthesis' AS pathway, m || '-UiO-67-' || k || '-Pt' AS catalyst_family, m AS metal, k AS linker, temperature_c, pressure_bar,
    h2_co2_ratio, reactor_type, X_CO2, 20 + q AS S_MeOH, 75 - q AS S_CO, 5::DOUBLE AS S_CH4, X_CO2 * (20 + q) / 100 AS Y_MeOH,
    'CH3OH (methanol)' AS primary_product, 'experimental' AS data_source FROM lines WHERE l_linestatus = 'O'
  UNION ALL SELECT lp, lc, 'N/A', 'N/A', temperature_c, pressure_bar, h2_co2_ratio, reactor_type, X_CO2,
    CASE WHEN lp LIKE '%Methanol%' THEN 50 + q ELSE 0 END, CASE WHEN lp LIKE '%CO route%' THEN 50 + q ELSE 0 END,
    CASE WHEN lp LIKE '%methanation%' THEN 50 + q ELSE 0 END, CASE WHEN lp LIKE '%Methanol%' THEN X_CO2 * (50 + q) / 100 ELSE 0 END,
    lprod, 'literature' FROM lines WHERE l_linestatus = 'F')"""
LINES = f"""lines AS (SELECT l_linestatus, l_quantity AS q, 20 + 8 * l_quantity AS temperature_c, 1 + 500 * l_discount AS pressure_bar,
  1 + 50 * l_tax AS h2_co2_ratio, {REACTOR} AS reactor_type, l_extendedprice / 1100 AS X_CO2,
  {pick('l_suppkey % 2', ['Hf', 'Zr'])} AS m, {pick('l_partkey % 2', ['BA', 'FA'])} AS k, {pick('l_partkey % 5', NAMES)} AS lp,
  {pick('l_partkey % 5', [c for c, _ in CATALYSTS][:5])} AS lc, {pick('l_partkey % 5', [r[1] for r in PATHWAYS])} AS lprod FROM lineitem)"""
TRAINING = [
    LINES,
    RUNS,
    """tt AS (SELECT *, 1000 / (temperature_c + 273.15::DOUBLE) AS inv_t, temperature_c * pressure_bar AS temp_pressure, ln(pressure_bar + 1) AS ln_pressure,
  CASE WHEN pathway LIKE '%Electro%' THEN 0 ELSE 1 END AS is_thermal, CASE WHEN pathway LIKE '%methanation%' THEN 1 ELSE 0 END AS is_methanation,
  CASE WHEN pathway LIKE '%Methanol%' THEN 1 ELSE 0 END AS is_methanol FROM runs)""",
]
CODES = "codes AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS label, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM tt)"
    for c in ("pathway", "catalyst_family", "reactor_type")
) + ")"


# Boosted trees: the training itself as SQL, a few CTEs per level of a tree, all models beside each other. The learner's settings.

BOOST_FEATURES = [
    "pathway_encoded", "catalyst_encoded", "reactor_encoded", "temperature_c", "pressure_bar", "h2_co2_ratio", "1000_T_K", "temp_pressure", "ln_pressure",
    "is_thermal", "is_methanation", "is_methanol",
]
BOOST_TREES, BOOST_DEPTH, BOOST_RATE, BOOST_ROWS, BOOST_COLUMNS, BOOST_SEED, BOOST_BINS = 3, 3, 0.08, 0.8, 9, 42, 64
WHOLE_TREES, WHOLE_DEPTH = 150, 5


def drawn(*what: object) -> int:
    return int(md5(":".join(map(str, (BOOST_SEED, *what))).encode()).hexdigest()[:8], 16)


def labelled() -> list[str]:
    """`lab`: the labelled runs with codes, features, side, fold and mark; `bin`: the same in bins; `pt`: all points' features."""
    code = "dense_rank() OVER (ORDER BY {c}) - 1"
    numbers = [code.format(c=c) for c in ("pathway", "catalyst", "reactor")] + [
        "temp", "press", "h2", "1000 / (temp + 273.15::DOUBLE)", "temp * press", "ln(press + 1)",
        "CASE WHEN pathway LIKE '%Electro%' THEN 0 ELSE 1 END", "CASE WHEN pathway LIKE '%methanation%' THEN 1 ELSE 0 END", "CASE WHEN pathway LIKE '%Methanol%' THEN 1 ELSE 0 END",
    ]
    shares = ", ".join(f"{i / BOOST_BINS!r}::DOUBLE" for i in range(1, BOOST_BINS))
    starts = ", ".join(f"{k} * (n // 5) + least({k}, n % 5)" for k in range(1, 5))
    return [
        f"""lab AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_partkey, pathway, temp, press, h2, l_orderkey * 10 + l_linenumber AS ord,
  greatest(least(yield_pct * 1.2::DOUBLE + ((l_orderkey * 7 + l_linenumber) % 11 - 5) / 10.0::DOUBLE, 100), 0)::DOUBLE AS y0,
  (CASE WHEN pathway = 'Methanol synthesis' THEN yield_pct ELSE 0 END)::DOUBLE AS y1,
  ('0x' || substr(md5('42:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 100 < 80 AS is_train,
  ('0x' || substr(md5('42:row:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT AS mark,
  {', '.join(f'({x})::DOUBLE AS f{i}' for i, x in enumerate(numbers))} FROM sc)""",
        f"""starts AS (SELECT list(ord) AS ords FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS place, count(*) OVER () AS n FROM lab) WHERE place IN ({starts}))""",
        "cuts AS MATERIALIZED (SELECT "
        + ", ".join(f"list_sort(list_distinct(quantile_disc(f{i}, [{shares}]))) AS q{i}" for i in range(len(BOOST_FEATURES)))
        + " FROM lab)",
        "bin AS MATERIALIZED (SELECT lab.*, len(list_filter(ords, lambda s: s <= ord)) AS fold, "
        + ", ".join(f"len(list_filter(q{i}, lambda c: c < f{i})) AS b{i}" for i in range(len(BOOST_FEATURES)))
        + " FROM lab, starts, cuts)",
    ]


def boosted(folds: bool) -> list[str]:
    """`nodes`: the node table of all models; `s{trees}`: every row with every model's prediction `now`."""
    used = [(f"{t}/{k}", j, f"fold <> {k}") for j, t in enumerate(model.TARGETS) for k in range(5)] if folds else [(t, j, "is_train") for j, t in enumerate(model.TARGETS)]
    models = " UNION ALL ".join(f"SELECT {text(n)} AS model, {j} AS target, {w} AS used, y{j} AS y, * EXCLUDE (y0, y1) FROM bin" for n, j, w in used)
    bits = ", ".join(f"18 - coalesce(ceil(log2(nullif(max(y{j}) - min(y{j}), 0))), 0) AS e{j}" for j in range(2))
    out = [
        f"bits AS MATERIALIZED (SELECT {bits} FROM lab)",
        f"m0 AS MATERIALIZED (SELECT m.*, pow(2::DOUBLE, CASE target WHEN 0 THEN e0 ELSE e1 END) AS q FROM ({models}) m, bits)",
        "bases AS MATERIALIZED (SELECT model, sum(floor(y * q + 0.5::DOUBLE))::DOUBLE / count(*) / any_value(q) AS base, count(*) AS base_rows FROM m0 WHERE used GROUP BY model)",
        "s0 AS MATERIALIZED (SELECT m0.*, base AS now, floor((y - base) * q + 0.5::DOUBLE)::BIGINT AS res FROM m0 JOIN bases USING (model))",
    ]
    nodes = ["SELECT model, 0 AS tree, 0 AS node, NULL::VARCHAR AS feature, NULL::DOUBLE AS threshold, NULL::INTEGER AS left_node, NULL::INTEGER AS right_node, base AS value, NULL::DOUBLE AS gain, base_rows AS n_rows FROM bases"]
    names = "CASE f " + " ".join(f"WHEN {i} THEN {text(n)}" for i, n in enumerate(BOOST_FEATURES)) + " END"
    cut = "CASE f " + " ".join(f"WHEN {i} THEN q{i}[cut + 1]" for i in range(len(BOOST_FEATURES))) + " END"
    column = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(BOOST_FEATURES))) + " END"
    for t in range(BOOST_TREES):
        chosen = sorted(sorted(range(len(BOOST_FEATURES)), key=lambda f, t=t: (drawn("column", t, f), f))[:BOOST_COLUMNS])
        pairs = ", ".join(f"{{'f': {f}, 'bin': b{f}}}" for f in chosen)
        out.append(
            f"""n{t}_0 AS MATERIALIZED (SELECT *, 0 AS node, used AND (mark + {drawn('row', t)}) % 4294967296 < {int(BOOST_ROWS * (1 << 32))} AS sampled,
  res AS g FROM s{t})"""
        )
        grown = f"SELECT model, 0 AS node, sum(g)::DOUBLE AS g, count(*) AS n, any_value(q) AS q FROM n{t}_0 WHERE sampled GROUP BY model"
        splits = []
        for level in range(BOOST_DEPTH):
            key = f"{t}_{level}"
            out += [
                f"""h{key} AS MATERIALIZED (SELECT model, node, p.f AS f, p.bin AS bin, sum(g) AS g, count(*) AS n, any_value(q) AS q
  FROM (SELECT model, node, g, q, unnest([{pairs}]) AS p FROM n{key} WHERE sampled AND node >= {(1 << level) - 1}) GROUP BY ALL)""",
                f"""c{key} AS (SELECT model, node, f, bin AS cut, q, (sum(g) OVER w)::DOUBLE AS lg, (sum(n) OVER w)::DOUBLE AS ln, (sum(g) OVER v)::DOUBLE AS ag, (sum(n) OVER v)::DOUBLE AS an
  FROM h{key} WINDOW w AS (PARTITION BY model, node, f ORDER BY bin), v AS (PARTITION BY model, node, f))""",
                f"""b{key} AS MATERIALIZED (SELECT * FROM (SELECT *, lg * lg / (ln + 1) + (ag - lg) * (ag - lg) / (an - ln + 1) - ag * ag / (an + 1) AS gain FROM c{key}
  WHERE ln >= 1 AND an - ln >= 1) WHERE gain > 1 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, cut) = 1)""",
                f"""n{t}_{level + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN f IS NULL THEN n.node ELSE 2 * n.node + 1 + ({column} > cut)::INTEGER END AS node)
  FROM n{key} n LEFT JOIN (SELECT model, node, f, cut FROM b{key}) b ON b.model = n.model AND b.node = n.node AND n.node >= {(1 << level) - 1})""",
            ]
            splits.append(f"SELECT * FROM b{key}")
            grown += f" UNION ALL SELECT model, 2 * node + 1, lg, ln, q FROM b{key} UNION ALL SELECT model, 2 * node + 2, ag - lg, an - ln, q FROM b{key}"
        out += [
            f"g{t} AS MATERIALIZED (SELECT model, node, floor({BOOST_RATE!r}::DOUBLE * (g / (n + 1)) + 0.5::DOUBLE) / q AS value, q, n FROM ({grown}))",
            f"k{t} AS MATERIALIZED (SELECT model, node, {names} AS feature, {cut} AS threshold, gain / (q * q) AS gain FROM ({' UNION ALL '.join(splits)}), cuts)",
            f"s{t + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node, sampled, g) REPLACE (now + value AS now, res - (value * n.q)::BIGINT AS res) FROM n{t}_{BOOST_DEPTH} n JOIN (SELECT model, node, value FROM g{t}) USING (model, node))",
        ]
        nodes.append(
            f"""SELECT model, {t + 1}, node, feature, threshold, CASE WHEN feature IS NOT NULL THEN 2 * node + 1 END, CASE WHEN feature IS NOT NULL THEN 2 * node + 2 END,
  CASE WHEN feature IS NULL THEN value END, gain, n FROM g{t} LEFT JOIN k{t} USING (model, node)"""
        )
    return [*out, f"nodes AS MATERIALIZED ({' UNION ALL '.join(nodes)})"]


def boosted_whole() -> list[str]:
    """`ended`: every row with every model's prediction `now` after all rounds of the whole models. A round is one step of a recursive CTE whose rows carry what the trees so far say, in quanta."""
    columns = range(len(BOOST_FEATURES))
    chosen = [sorted(sorted(columns, key=lambda f, t=t: (drawn("column", t, f), f))[:BOOST_COLUMNS]) for t in range(WHOLE_TREES)]
    draws = ", ".join(f"({t}, {own}, {drawn('row', t)})" for t, own in enumerate(chosen))
    steps = [
        f"""n0 AS MATERIALIZED (SELECT w.model, w.id, w.said, s.res - w.said AS g, q, bins, chosen, 0 AS node, used AND (mark + step) % 4294967296 < {int(BOOST_ROWS * (1 << 32))} AS sampled
  FROM whole w JOIN first s ON s.model = w.model AND s.id = w.id JOIN draws d ON d.tree = w.tree)"""
    ]
    grown = "SELECT model, 0 AS node, sum(g)::DOUBLE AS g, count(*) AS n, any_value(q) AS q FROM n0 WHERE sampled GROUP BY model"
    for level in range(WHOLE_DEPTH):
        steps += [
            f"""h{level} AS MATERIALIZED (SELECT model, node, f, bins[f + 1] AS bin, sum(g) AS g, count(*) AS n, any_value(q) AS q
  FROM (SELECT model, node, g, q, bins, unnest(chosen) AS f FROM n{level} WHERE sampled AND node >= {(1 << level) - 1}) GROUP BY ALL)""",
            f"""c{level} AS (SELECT model, node, f, bin AS cut, q, (sum(g) OVER w)::DOUBLE AS lg, (sum(n) OVER w)::DOUBLE AS ln, (sum(g) OVER v)::DOUBLE AS ag, (sum(n) OVER v)::DOUBLE AS an
  FROM h{level} WINDOW w AS (PARTITION BY model, node, f ORDER BY bin), v AS (PARTITION BY model, node, f))""",
            f"""b{level} AS MATERIALIZED (SELECT * FROM (SELECT *, lg * lg / (ln + 1) + (ag - lg) * (ag - lg) / (an - ln + 1) - ag * ag / (an + 1) AS gain FROM c{level}
  WHERE ln >= 1 AND an - ln >= 1) WHERE gain > 1 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, cut) = 1)""",
            f"""n{level + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN f IS NULL THEN n.node ELSE 2 * n.node + 1 + (bins[f + 1] > cut)::INTEGER END AS node)
  FROM n{level} n LEFT JOIN (SELECT model, node, f, cut FROM b{level}) b ON b.model = n.model AND b.node = n.node)""",
        ]
        grown += f" UNION ALL SELECT model, 2 * node + 1, lg, ln, q FROM b{level} UNION ALL SELECT model, 2 * node + 2, ag - lg, an - ln, q FROM b{level}"
    steps.append(f"g AS MATERIALIZED (SELECT model, node, floor({BOOST_RATE!r}::DOUBLE * (g / (n + 1)) + 0.5::DOUBLE)::BIGINT AS value FROM ({grown}))")
    return [
        *boosted(False)[:4],
        f"draws AS MATERIALIZED (SELECT * FROM (VALUES {draws}) v(tree, chosen, step))",
        f"first AS MATERIALIZED (SELECT model, target, id, now AS base, q, res, used, mark, [{', '.join(f'b{i}' for i in columns)}]::UTINYINT[] AS bins FROM s0)",
        f"""whole AS (SELECT model, id, 0 AS tree, 0::BIGINT AS said FROM first UNION ALL (WITH {", ".join(steps)}
  SELECT n.model, n.id, t.tree, n.said + g.value FROM n{WHOLE_DEPTH} n JOIN g ON g.model = n.model AND g.node = n.node CROSS JOIN (SELECT max(tree) + 1 AS tree FROM whole) t))""",
        f"ended AS MATERIALIZED (SELECT w.id, s.target, s.base + w.said / s.q AS now FROM whole w JOIN first s ON s.model = w.model AND s.id = w.id WHERE w.tree = {WHOLE_TREES})",
    ]


def boost_queries() -> dict[str, str]:
    data = [POINTS, *scored("points"), *labelled()]
    one = [*data, *boosted(False)]
    last = f"s{BOOST_TREES}"
    both = """pr AS MATERIALIZED (SELECT id, greatest(least(max(now) FILTER (WHERE target = 0), 100), 0) AS x, greatest(least(max(now) FILTER (WHERE target = 1), 100), 0) AS y
  FROM ended GROUP BY id)"""
    whole = [*data, *boosted_whole(), both]
    selectivity = "CASE WHEN x > 0.01 THEN greatest(least(y / x * 100, 100), 0) ELSE 0 END"
    distance = """(CASE WHEN temp < 170 THEN (170 - temp) / 170 WHEN temp > 240 THEN (temp - 240) / 240 ELSE 0 END
  + CASE WHEN press < 1 THEN 0.2::DOUBLE WHEN press > 50 THEN (press - 50) / 50 ELSE 0 END
  + CASE WHEN h2 < 1 OR h2 > 4 THEN least(abs(h2 - 1), abs(h2 - 4)) / 4 ELSE 0 END)"""
    figures = """count(*) AS n_rows, round(1 - sum((y - now) * (y - now)) / nullif(var_pop(y) * count(*), 0), 6) AS r2,
  round(sqrt(avg((y - now) * (y - now))), 6) AS rmse"""
    curve = " UNION ALL ".join(
        f"SELECT model AS target, is_train, {t} AS round, round(sqrt(avg((y - now) * (y - now))), 6) AS rmse FROM s{t} GROUP BY ALL" for t in range(1, BOOST_TREES + 1)
    )
    every = " UNION ALL ".join(f"SELECT {text(n)} AS feature" for n in BOOST_FEATURES)
    renamed = [_other(x) for x in boosted(True)]
    return {
        "boost_nodes": query(
            one, "SELECT model, tree, node, feature, round(threshold, 6) AS threshold, left_node, right_node, round(value, 6) AS value, round(gain, 6) AS gain, n_rows::BIGINT AS n_rows FROM nodes"
        ),
        "boost_predict": query(
            whole,
            f"""SELECT l_orderkey, l_linenumber, l_partkey, round(x, 6) AS X_CO2, round(y, 6) AS Y_MeOH, round({selectivity}, 6) AS S_MeOH,
  round(greatest(least(exp(-3 * {distance} / 3), 1), 0), 6) AS confidence FROM lab JOIN pr USING (id)""",
            recursive=True,
        ),
        "boost_route": query(
            whole,
            f"""SELECT {text(model.RULE_NAME)} AS model_used, {text(model.RULE_CONFIDENCE)} AS data_confidence, pathway, product AS primary_product, count(*) AS n_points,
  round(avg(yield_pct), 6) AS mean_yield, round(avg(carbon_util_pct), 6) AS mean_carbon FROM sc WHERE pathway <> 'Methanol synthesis' GROUP BY ALL
  UNION ALL SELECT 'XGBoost ML', 'High 🟢', pathway, 'CH3OH (methanol)', count(*), round(avg(round(y, 1)), 6), round(avg(round(least(x * 0.9::DOUBLE, 95), 1)), 6)
  FROM lab JOIN pr USING (id) WHERE pathway = 'Methanol synthesis' GROUP BY ALL""",
            recursive=True,
        ),
        "boost_importance": query(
            [*one, "gains AS (SELECT model, feature, avg(gain) AS gain FROM nodes WHERE feature IS NOT NULL GROUP BY ALL)"],
            f"""SELECT t.model AS target, e.feature, round(coalesce(gain / sum(gain) OVER (PARTITION BY t.model), 0), 6) AS importance
  FROM (SELECT DISTINCT model FROM bases) t CROSS JOIN ({every}) e LEFT JOIN gains g ON g.model = t.model AND g.feature = e.feature""",
        ),
        "boost_learning_curve": query(one, curve),
        "boost_report": query(
            [
                *one,
                f"sides AS (SELECT model AS target, is_train, {figures} FROM {last} GROUP BY ALL)",
                *renamed,
                f"""folds AS (SELECT model[:-3] AS target, fold, 1 - sum((y - now) * (y - now)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM cv_{last} WHERE NOT used GROUP BY ALL)""",
                "summary AS (SELECT target, round(avg(r2), 6) AS cv_r2_mean, round(stddev_pop(r2), 6) AS cv_r2_std FROM folds GROUP BY target)",
            ],
            """SELECT target, max(r2) FILTER (WHERE is_train) AS train_r2, max(r2) FILTER (WHERE NOT is_train) AS test_r2, max(rmse) FILTER (WHERE is_train) AS train_rmse,
  max(rmse) FILTER (WHERE NOT is_train) AS test_rmse, any_value(cv_r2_mean) AS cv_r2_mean, any_value(cv_r2_std) AS cv_r2_std FROM sides JOIN summary USING (target) GROUP BY target""",
        ),
    }


def _other(cte: str) -> str:
    """A CTE of `boosted` under other names, so that two trainings fit in one query."""
    return re.sub(r"\b(bits|m0|bases|nodes|[snhcb]\d+_\d+|[sgk]\d+)\b(?=[\s).,]|$)", r"cv_\1", cte)


def training_queries() -> dict[str, str]:
    doubles = ["temperature_c", "pressure_bar", "h2_co2_ratio", "X_CO2", "S_MeOH", "S_CO", "S_CH4", "Y_MeOH", "inv_t", "temp_pressure", "ln_pressure"]
    whole = ["pathway", "catalyst_family", "metal", "linker", "reactor_type", "primary_product", "data_source", "is_thermal", "is_methanation", "is_methanol"]
    ranges = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM tt"
        for c in ("temperature_c", "pressure_bar", "X_CO2", "Y_MeOH")
    )
    scaled = ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 7) AS {c}_z"
        for c in ("temperature_c", "pressure_bar", "h2_co2_ratio", "ln_pressure")
    )
    lookup = " ".join(
        f"LEFT JOIN (SELECT label, code FROM codes WHERE column_name = '{c}') {a} ON {a}.label = {e}"
        for c, a, e in (("pathway", "p", "pathway"), ("catalyst_family", "c", "catalyst"), ("reactor_type", "r", "reactor"))
    )
    known = "p.code IS NOT NULL AND c.code IS NOT NULL AND r.code IS NOT NULL"
    return {
        "training_table": query(TRAINING, f"SELECT {', '.join(whole)}, {', '.join(f'round({c}, 6) AS {c}' for c in doubles)} FROM tt"),
        "methanol_subset": query(
            TRAINING,
            "SELECT catalyst_family, count(*) AS n_rows, round(avg(Y_MeOH), 6) AS mean_y_meoh FROM tt "
            "WHERE pathway = 'Methanol synthesis' AND data_source = 'experimental' GROUP BY 1",
        ),
        "profile_describe": query(
            TRAINING,
            "SELECT pathway, count(X_CO2) AS n, round(avg(X_CO2), 6) AS mean, round(stddev_samp(X_CO2), 6) AS std, round(min(X_CO2), 6) AS low, "
            "round(max(X_CO2), 6) AS high, round(quantile_cont(X_CO2, 0.25), 6) AS q25, round(quantile_cont(X_CO2, 0.5), 6) AS q50, "
            "round(quantile_cont(X_CO2, 0.75), 6) AS q75 FROM tt GROUP BY 1",
        ),
        "profile_counts": query(TRAINING, "SELECT catalyst_family, count(*) AS n_rows FROM tt GROUP BY 1"),
        "profile_ranges": query(TRAINING, ranges),
        "profile_sources": query(
            TRAINING,
            "SELECT count(*) AS n_rows, count(*) FILTER (WHERE data_source = 'experimental') AS n_experimental, "
            "count(*) FILTER (WHERE data_source = 'literature') AS n_literature, count(DISTINCT pathway) AS n_pathways, "
            "count(DISTINCT catalyst_family) AS n_catalysts FROM tt",
        ),
        "profile_sketches": query(
            [POINTS], "SELECT pathway, count(temp) AS n, count(DISTINCT l_partkey) AS n_distinct, TRUE AS distinct_ok, TRUE AS quantiles_ok FROM points GROUP BY 1"
        ),
        "sample_rows": query(
            [POINTS],
            "SELECT l_orderkey, l_linenumber, l_partkey, pathway, round(temp, 6) AS temperature_c FROM points "
            "ORDER BY l_orderkey, l_linenumber, l_partkey, temp LIMIT 10",
        ),
        "label_codes": query([*TRAINING, CODES], "SELECT column_name, label, code FROM codes"),
        "unknown_category": query(
            [*TRAINING, CODES, POINTS],
            f"SELECT pathway, catalyst AS catalyst_family, reactor AS reactor_type, CASE WHEN {known} THEN p.code ELSE 0 END AS pathway_encoded, "
            f"CASE WHEN {known} THEN c.code ELSE 0 END AS catalyst_encoded, CASE WHEN {known} THEN r.code ELSE 0 END AS reactor_encoded, "
            f"count(*) AS n_points FROM points {lookup} GROUP BY ALL",
        ),
        "standardise": query(TRAINING, f"SELECT pathway, data_source, {scaled} FROM tt"),
        "holdout_split": "SELECT is_train, count(*) AS n_rows FROM (SELECT ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 100 < 80 AS is_train "
        "FROM orders) GROUP BY 1",
        "fold_sizes": "SELECT f - 1 AS fold, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key "
        "FROM (SELECT o_orderkey, ntile(5) OVER (ORDER BY o_orderkey) AS f FROM orders) GROUP BY f",
    }


GRID_INDEXES = ["t_index", "p_index", "h_index"]

# Columns that the queries return as 32-bit integers.
INTEGERS = {
    "series_read_filter": ["first_period", "last_period"],
    **dict.fromkeys(["region_filter", "nation_forecast", "forecast_best", "forecast_guard_yearly", "arima_closed_form"], ["t"]),
    "backtest_mape": ["n_periods", "n_test"],
    **{f"poly_forecast_d{d}": ["t"] for d in (1, 2, 3, 4)},
    **{f"pathway_{name}": ["t"] for name in (*SHAPES, "milestones")},
    "scenario_gap": ["t"],
    "commitments_parse": ["action_idx", "n_knots"],
    "unsorted_years": ["action_idx"],
    **dict.fromkeys(["reduction_by_year", "reduction_by_year_rows", "absolute_reduction", "annual_fraction", "annual_fraction_entries", "sector_progress"], ["year"]),
    "data_gap": ["last_data_year", "gap_years"],
    "sector_report": ["progress_year"],
    "policy_pathway": ["t"],
    "scenario_policy": ["t"],
    "grid_search_top10": GRID_INDEXES,
    "grid_best_per_unit": ["rank", *GRID_INDEXES],
    "grid_selectivity_top10": GRID_INDEXES,
    "grid_heatmap": ["t_index"],
    "label_codes": ["code"],
    "unknown_category": ["pathway_encoded", "catalyst_encoded", "reactor_encoded"],
    "fold_sizes": ["fold"],
    "boost_nodes": ["tree", "node", "left_node", "right_node"],
    "boost_learning_curve": ["round"],
}


def typed(name: str, sql: str) -> str:
    if name not in INTEGERS:
        return sql
    casts = ", ".join(f"{c}::INTEGER AS {c}" for c in INTEGERS[name])
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)"


def oracle_sql() -> dict[str, str]:
    plain = {**series_queries(), **scenario_queries(), **policy_queries(), **process_queries(), **training_queries(), **boost_queries()}
    return {name: typed(name, sql) for name, sql in plain.items()}
