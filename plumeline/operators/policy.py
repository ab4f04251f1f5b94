"""Policy commitments as tables: parsing, shares, targets, reduction by year and the policy-driven path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.columns import at_least, at_most
from plumeline.operators.asof import asof_join
from plumeline.operators.pathways import smooth_declining

ACTION_TYPE = (
    "struct<sector:string,action_name:string,baseline_year:double,baseline_emissions_mtco2:double,"
    "share_pct:double,reduction_target_pct:double,removal_increase_pct:double,"
    "implementation_years:array<double>,yearly_improvement_pct:array<double>,status:string>"
)
COMMITMENT_TYPE = (
    "struct<country:string,mode:string,target_year:double,baseline_year:double,baseline_emissions_gtco2:double,"
    f"target_reduction_pct:double,policy_actions:array<{ACTION_TYPE}>>"
)

# Damping of the trend beyond the last data year, its bounds, the shortest time to the
# target without a target year, and the limits of the data-gap classes.
DAMPING = 0.05
TREND_LOW, TREND_HIGH = 0.0, 150.0
SHORTEST_SPAN = 10
LARGE_GAP_YEARS = 5

# Labels and texts.
SINK_LABEL, EMITTER_LABEL = "Removal Increase", "Reduction Target"
NOT_FOUND = "Country '{entry}' not found. Available: {some}"
SHORTENED = " and {more} more"


def parse_commitments(docs: DataFrame, text: str, keys: list[str], allow_comments: bool = False) -> DataFrame:
    """One row per country of each document, with its actions as an array. Broken documents give no row.

    Years may be written as 2050 or 2050.0."""
    options = {"allowComments": "true"} if allow_comments else {}
    parsed = F.from_json(F.col(text), f"map<string,{COMMITMENT_TYPE}>", options)
    return docs.select(*keys, F.posexplode(parsed).alias("country_pos", "entry", "c")).select(
        *keys,
        "country_pos",
        "entry",
        "c.country",
        F.coalesce("c.mode", F.lit("target")).alias("mode"),
        F.col("c.target_year").cast("int").alias("target_year"),
        F.col("c.baseline_year").cast("int").alias("baseline_year"),
        "c.baseline_emissions_gtco2",
        "c.target_reduction_pct",
        F.col("c.policy_actions").cast(f"array<{ACTION_TYPE.replace('_year:double', '_year:int').replace('years:array<double>', 'years:array<int>')}>").alias("policy_actions"),
    )


def list_countries(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The top-level names of each document in order; a broken document gives none."""
    valid = F.expr(f"try_parse_json(`{text}`)").isNotNull()
    return docs.filter(valid).select(*keys, F.posexplode(F.json_object_keys(F.col(text))).alias("country_pos", "entry"))


def find_commitment(commitments: DataFrame, entry: str, most_names: int = 1000) -> DataFrame:
    """The rows of one entry; raises `KeyError` naming the entries that exist when there are none: all of them, or the first
    `most_names` and how many more there are."""
    found = commitments.filter(F.col("entry") == entry)
    if found.isEmpty():
        names = commitments.select("entry").distinct()
        some = [row.entry for row in names.orderBy("entry").limit(most_names).collect()]
        more = names.count() - len(some)
        raise KeyError(NOT_FOUND.format(entry=entry, some=some) + (SHORTENED.format(more=more) if more else ""))
    return found


def with_entry(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys of one country: a document may hold several, so its `entry` counts as a key wherever that column is there."""
    return [*keys, "entry"] if "entry" in df.columns and "entry" not in keys else list(keys)


def is_forecast_mode() -> Column:
    return F.coalesce(F.col("mode") == "forecast", F.lit(False)) | F.col("target_reduction_pct").isNull()


def commitment_targets(commitments: DataFrame) -> DataFrame:
    """Adds the mode flag and the target emissions; in forecast mode the target stays the baseline."""
    cut = F.lit(1.0) - F.col("target_reduction_pct") / F.lit(100.0)
    return commitments.withColumn("forecast_mode", is_forecast_mode()).withColumn(
        "target_emissions_gtco2",
        F.col("baseline_emissions_gtco2") * F.coalesce(cut, F.lit(1.0)),
    )


def mode_mismatch(commitments: DataFrame, expected: str) -> DataFrame:
    return commitments.filter(F.coalesce(F.col("mode"), F.lit("target")) != expected)


def commitment_actions(commitments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per action, with a manual share kept apart from the calculated one. `entry` stays as a key."""
    keys = with_entry(commitments, keys)
    exploded = commitments.select(
        *keys,
        is_forecast_mode().alias("forecast_mode"),
        "target_year",
        "target_reduction_pct",
        "baseline_emissions_gtco2",
        F.posexplode("policy_actions").alias("action_idx", "a"),
    )
    return exploded.select(
        *keys,
        "forecast_mode",
        "target_year",
        "target_reduction_pct",
        "baseline_emissions_gtco2",
        "action_idx",
        "a.sector",
        "a.action_name",
        F.col("a.baseline_year").alias("action_baseline_year"),
        "a.baseline_emissions_mtco2",
        F.col("a.share_pct").alias("manual_share_pct"),
        "a.reduction_target_pct",
        "a.removal_increase_pct",
        "a.implementation_years",
        "a.yearly_improvement_pct",
        "a.status",
    )


def target_pct() -> Column:
    """Sinks prefer the removal increase, emitters the reduction; each falls back to the other."""
    reduction, removal = F.col("reduction_target_pct"), F.col("removal_increase_pct")
    return F.when(F.col("baseline_emissions_mtco2") < 0, F.coalesce(removal, reduction)).otherwise(
        F.coalesce(reduction, removal)
    )


def action_shares(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `share_pct`: the manual share, else the part of the gross (positive) baseline, 0 for sinks.

    The gross sum is combined on the map side and joined back, so a country that owns a large part of
    all actions is not pulled into one window.
    """
    keys = with_entry(actions, keys)
    baseline = F.col("baseline_emissions_mtco2")
    gross = actions.groupBy(*keys).agg(F.sum(F.when(baseline > 0, baseline)).alias("gross_mtco2"))
    calculated = F.when(baseline > 0, F.try_divide(baseline, F.col("gross_mtco2")) * 100.0).otherwise(0.0)
    return actions.join(gross, keys).withColumn("share_pct", F.coalesce(F.col("manual_share_pct"), calculated))


def share_quality(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the shares per country; manual shares are not rescaled, so it can differ from 100."""
    keys = with_entry(shares, keys)
    return shares.groupBy(*keys).agg(
        F.sum("share_pct").alias("share_sum"),
        F.sum(F.col("manual_share_pct").isNotNull().cast("int")).alias("manual_shares"),
    )


def sector_breakdown(actions: DataFrame, keys: list[str]) -> DataFrame:
    return actions.groupBy(*with_entry(actions, keys), "sector").agg(F.sum("baseline_emissions_mtco2").alias("baseline_mtco2"))


def sector_contributions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Reduction at the target per sector (negative for sinks); an action without a target adds nothing."""
    amount = F.col("baseline_emissions_mtco2") * target_pct() / 100.0
    return actions.groupBy(*with_entry(actions, keys), "sector").agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("contribution_mtco2"))


# Least-squares slope of the knots on centred years; null for fewer than two distinct years.
KNOT_SLOPE = """
CASE WHEN size(_knots) >= 2 THEN try_divide(
  aggregate(_knots, 0D, (s, k) -> s + (k.y - _mean_year) * (k.p - _mean_pct)),
  aggregate(_knots, 0D, (s, k) -> s + (k.y - _mean_year) * (k.y - _mean_year))
) END"""


def with_knots(actions: DataFrame) -> DataFrame:
    """Adds what `reduction_pct` reads from an action's data: sorted knots, ends and trend."""
    pairs = "transform(implementation_years, (y, i) -> named_struct('y', y, 'p', get(yearly_improvement_pct, i)))"
    return (
        actions.withColumn("target_pct", target_pct())
        .selectExpr("*", f"array_sort({pairs}) AS _knots")
        .selectExpr(
            "*",
            "get(_knots, 0) AS _first",
            "try_element_at(_knots, -1) AS _end",
            "try_divide(aggregate(_knots, 0D, (s, k) -> s + k.y), size(_knots)) AS _mean_year",
            "try_divide(aggregate(_knots, 0D, (s, k) -> s + k.p), size(_knots)) AS _mean_pct",
        )
        .selectExpr("* EXCEPT (_mean_year, _mean_pct)", f"{KNOT_SLOPE} AS _slope")
    )


BEFORE, AFTER = "try_element_at(filter(_knots, k -> k.y <= {year}), -1)", "get(filter(_knots, k -> k.y > {year}), 0)"


def reduction_pct(year: str, target_year: str | None = None, before: str = BEFORE, after: str = AFTER, several: str = "size(_knots) >= 2") -> Column:
    """Cumulative reduction of an action in a year. Reads the columns of `with_knots`, or, with knots as rows, the neighbours of the year.

    Zero before the baseline year and before the first knot; linear between knots; beyond the last
    knot a damped trend (none where all knots share a year) when there is no target, the target when it is already passed, and otherwise a
    line to the target. Without a target year that line takes the data span, at least ten years.
    """
    before, after = before.format(year=year), after.format(year=year)
    between = (
        f"{before}.p + coalesce(({after}.p - {before}.p) * try_divide({year} - {before}.y, {after}.y - {before}.y), 0D)"
    )
    elapsed = f"CAST({year} - _end.y AS DOUBLE)"
    trend = f"_end.p + coalesce(_slope, 0D) * {elapsed} / (1D + {DAMPING}D * {elapsed})"
    span = f"greatest({SHORTEST_SPAN}, _end.y - _first.y)"
    if target_year is not None:
        span = f"CASE WHEN {target_year} > _end.y THEN {target_year} - _end.y ELSE {span} END"
    return F.expr(
        f"""CASE WHEN {year} < action_baseline_year OR _end IS NULL OR {year} < _first.y THEN 0D
        WHEN {year} <= _end.y THEN {between}
        WHEN target_pct IS NULL OR target_pct = 0 THEN
          CASE WHEN {several} THEN least(greatest({trend}, {TREND_LOW}D), {TREND_HIGH}D) ELSE _end.p END
        WHEN _end.p >= target_pct THEN target_pct
        ELSE least(_end.p + try_divide(target_pct - _end.p, CAST({span} AS DOUBLE)) * {elapsed}, target_pct) END"""
    )


def reductions_by_year(actions: DataFrame, start: int, end: int, use_target_year: bool = True) -> DataFrame:
    """One row per action and year with `reduction_pct` and `absolute_reduction_mtco2`.

    The absolute amount never looks at the target year.
    """
    years = with_knots(actions).withColumn("year", F.explode(F.sequence(F.lit(start), F.lit(end))))
    return years.withColumns(
        {
            "reduction_pct": reduction_pct("year", "target_year" if use_target_year else None),
            "absolute_reduction_mtco2": F.col("baseline_emissions_mtco2") * reduction_pct("year") / 100.0,
        }
    ).drop("_knots", "_first", "_end", "_slope")


def knot_rows(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows `(keys..., year, pct)`: the knots of every action."""
    return with_knots(actions).select(*keys, F.inline("_knots")).select(*keys, F.col("y").cast("int").alias("year"), F.col("p").cast("double").alias("pct"))


def reductions_from_rows(actions: DataFrame, knots: DataFrame, asked: DataFrame, keys: list[str], use_target_year: bool = True) -> DataFrame:
    """`reductions_by_year` for knots that come as rows `(keys..., year, pct)`, of any number per action, and for the years of `asked(keys..., year)`.

    The neighbours of a year come from an as-of join, and the ends and the trend of an action from one aggregation of its knots; no row ever holds an
    action's knots together."""
    known = knots.na.drop(subset=[*keys, "year"])
    ends = known.groupBy(*keys).agg(
        F.min(F.struct(F.col("year").alias("y"), F.col("pct").alias("p"))).alias("_first"),
        F.max(F.struct(F.col("year").alias("y"), F.col("pct").alias("p"))).alias("_end"),
        F.regr_slope("pct", F.col("year").cast("double")).alias("_slope"),
        F.count(F.lit(1)).alias("_n"),
    )
    whole = actions.withColumn("target_pct", target_pct()).join(ends, keys, "left")
    near = asof_join(asked.select(*keys, "year"), known, keys, "year", ["pct"], "_b", "_a")
    near = near.withColumns({c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["year"].alias("y"), F.col(c)["pct"].alias("p"))) for c in ("_b", "_a")})
    neighbours = {"before": "_b", "after": "_a", "several": "_n >= 2"}
    return near.join(whole, keys).withColumns(
        {
            "reduction_pct": reduction_pct("year", "target_year" if use_target_year else None, **neighbours),
            "absolute_reduction_mtco2": F.col("baseline_emissions_mtco2") * reduction_pct("year", **neighbours) / 100.0,
        }
    ).drop("_a", "_b", "_first", "_end", "_slope", "_n")


def annual_fraction(shares: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Reduction as a fraction of the baseline per country and year, at most 1.

    Emitters count by share; sinks count their additional removal against the country baseline, and a zero
    baseline with a sink gives null. The country's baseline, mode, target year and reduction are carried along (each is the
    same on all its actions).
    """
    keys = with_entry(shares, keys)
    baseline, pct = F.col("baseline_emissions_mtco2"), F.col("reduction_pct") / 100.0
    emitters = F.when(baseline > 0, F.col("share_pct") / 100.0 * pct)
    sinks = F.when(
        baseline < 0, F.try_divide(F.abs(baseline) * pct, F.col("baseline_emissions_gtco2") * 1000.0)
    )
    return (
        reductions_by_year(shares, start, end)
        .groupBy(*keys, "year")
        .agg(
            F.coalesce(F.sum(emitters), F.lit(0.0)).alias("_e"),
            F.when(F.count_if((baseline < 0) & sinks.isNull()) == 0, F.coalesce(F.sum(sinks), F.lit(0.0))).alias("_s"),
            F.first("baseline_emissions_gtco2").alias("baseline_gtco2"),
            F.first("forecast_mode").alias("forecast_mode"),
            F.first("target_year").alias("target_period"),
            F.coalesce(F.first("target_reduction_pct"), F.lit(0.0)).alias("cut_pct"),
        )
        .select(
            *keys,
            "year",
            at_most(F.col("_e") + F.col("_s"), 1.0).alias("fraction"),
            "baseline_gtco2",
            "forecast_mode",
            "target_period",
            "cut_pct",
        )
    )


def data_horizon(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Last data year over all actions, years missing up to the target, and the size class of that gap."""
    keys = with_entry(actions, keys)
    last = F.coalesce(F.array_max("implementation_years"), F.lit(0))
    gap = F.col("target_year") - F.col("last_data_year")
    return (
        actions.groupBy(*keys)
        .agg(F.max("target_year").alias("target_year"), F.max(last).alias("last_data_year"))
        .withColumn("gap_years", gap)
        .withColumn(
            "gap_class",
            F.when(gap > LARGE_GAP_YEARS, F.lit("large")).when(gap > 0, F.lit("small")).otherwise(F.lit("none")),
        )
    )


def progress_table(actions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per action and knot: cumulative percent, change on the knot before, and the target line.

    The knots of one action sit in one row, so the change is read from the array without a window.
    """
    knots = F.transform(
        F.col("_knots"),
        lambda k, i: F.struct(
            k["y"].alias("year"),
            k["p"].alias("progress_pct"),
            (k["p"] - F.get(F.col("_knots"), i - 1)["p"]).alias("change_pct"),
        ),
    )
    return with_knots(actions).select(*with_entry(actions, keys), "action_idx", "sector", "target_pct", F.inline(knots))


def sector_report(shares: DataFrame, keys: list[str]) -> DataFrame:
    """One row per action: share, target and its label, status, latest progress and its yearly change."""
    previous = F.when(F.size("_knots") >= 2, F.try_element_at("_knots", F.lit(-2))["p"])
    return with_knots(shares).select(
        *with_entry(shares, keys),
        "action_idx",
        "sector",
        "action_name",
        "status",
        "baseline_emissions_mtco2",
        "share_pct",
        "target_pct",
        F.when(F.col("baseline_emissions_mtco2") < 0, F.lit(SINK_LABEL))
        .otherwise(F.lit(EMITTER_LABEL))
        .alias("target_label"),
        F.col("_end.y").alias("progress_year"),
        F.col("_end.p").alias("progress_pct"),
        (F.col("_end.p") - previous).alias("yearly_change_pct"),
    )


def policy_pathway(
    bau: DataFrame,
    fractions: DataFrame,
    starts: DataFrame,
    keys: list[str],
    time: str,
    unit: float = 1.0,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Rows `(keys..., time, path, target)`: the current value cut by the policy fraction.

    In target mode the path stays at or above the target and ends on it; it never exceeds business as usual
    and never rises. `bau` has `(keys..., time, bau)`; `fractions` has `(keys..., time, fraction, baseline_gtco2,
    forecast_mode, target_period, cut_pct)`; `starts` has `(keys..., current)`. A Gt of the baseline is `unit` in the series.

    The target is the baseline less `cut_pct` percent, or the column `target` of `targets` (`keys..., target`), as
    `pathways.resolve_targets` gives it. In forecast mode it is the projected one, the baseline less the last fraction; the path ends
    where the policies lead, so the two differ where the current value is not the baseline.
    """
    baseline = F.col("baseline_gtco2") * unit
    rows = fractions.join(starts.select(*keys, "current"), keys).filter(F.col(time) <= F.col("target_period"))
    wanted = baseline * (F.lit(1.0) - F.col("cut_pct") / 100.0)
    if targets is not None:
        rows = rows.join(targets.select(*keys, F.col("target").alias("_target")), keys)
        wanted = F.col("_target")
    at_end = F.when(F.col(time) == F.col("target_period"), baseline * (F.lit(1.0) - F.col("fraction")))
    projected = F.max(at_end).over(Window.partitionBy(*keys))
    rows = rows.withColumn("target", F.when(F.col("forecast_mode"), projected).otherwise(wanted)).join(bau, [*keys, time])
    cut = F.col("current") * (F.lit(1.0) - F.col("fraction"))
    floored = F.when(F.col("forecast_mode"), cut).otherwise(at_least(cut, F.col("target")))
    per_path = [*keys, "target", "target_period", "forecast_mode"]
    smooth = smooth_declining(rows.withColumn("path", at_most(floored, F.col("bau"))), per_path, time, "path")
    last = ~F.col("forecast_mode") & (F.col(time) == F.col("target_period"))
    return smooth.select(*keys, time, F.when(last, F.col("target")).otherwise(F.col("path")).alias("path"), "target")
