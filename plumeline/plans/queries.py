"""The named queries. Each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions import columns
from plumeline.functions.process_tables import PRODUCTS
from plumeline.operators import asof, explore, features, forecast, model, pathways, policy, profile, ranks, scoring, series, sketches
from plumeline.operators import validation
from plumeline.plans import tables
from plumeline.session import use_checkpoint_dir

SITE = ["site"]
HORIZON = 12
SCENARIO_END = 120
POLICY_YEARS = (1994, 2034)
POLICY_END = 2030
TOP = 3
POLICY_UNIT = 9999991.0 / 997.0 / 7.0  # a Gt of the sites' baseline as yearly shipped value: seven years of lines are summed in it

SCENARIOS = [
    {"scenario": "net zero, straight", "pathway": "linear", "target_kind": "net_zero", "target_period": 120},
    {"scenario": "net zero, decay", "pathway": "exponential", "target_kind": "net_zero", "target_period": 120},
    {
        "scenario": "80 percent less",
        "pathway": "scurve",
        "target_kind": "percent",
        "target_amount": 80.0,
        "target_period": 108,
    },
    {
        "scenario": "absolute by steps",
        "pathway": "milestones",
        "target_kind": "absolute",
        "target_amount": 25.0,
        "target_period": 120,
        "milestones": {96: 120.0, 108: 70.0, 120: 99.0},
    },
    {"scenario": "steps without steps", "pathway": "milestones", "target_kind": "percent", "target_amount": 50.0, "target_period": 100},
    {"scenario": "too early", "pathway": "linear", "target_kind": "net_zero", "target_period": 40},
]


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles to a fixed number of decimals, so that results can be compared between engines."""
    return df.select(
        *[
            F.round(f"`{f.name}`", special.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# Series and forecasts


def series_read_filter(spark: SparkSession, folder: str) -> DataFrame:
    monthly = series.filter_periods(tables.site_series(spark, folder), "t", 13, 72)
    return rounded(series.spans(monthly, SITE, "t", "v"))


def regions_distinct(spark: SparkSession, folder: str) -> DataFrame:
    sites = tables.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("site"))
    return series.regions(sites, "site").orderBy("site")


def region_filter(spark: SparkSession, folder: str) -> DataFrame:
    nations = tables.nation_series(spark, folder)
    return rounded(series.filter_keys(nations, "n_name", [f"NATION_{i}" for i in range(0, 25, 3)], "t", "v"), v=8)


def nation_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast_best(tables.nation_series(spark, folder), ["n_name"], "t", "v", HORIZON, arima="closed_form"))


def poly_forecast(degree: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(forecast.poly_forecast(tables.site_series(spark, folder), SITE, "t", "v", HORIZON, degree))

    return run


def backtest_mape(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.backtest(tables.site_series(spark, folder), SITE, "t", "v", arima="closed_form"))


def arima_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    frame = forecast.scored_frame(tables.site_series(spark, folder), SITE, "t", "v", HORIZON, degree=1, arima="closed_form")
    return rounded(frame.filter("_future").select("site", "t", F.col("arima_order").alias("model"), F.col("arima_pred").alias("forecast")))


def arima_search(spark: SparkSession, folder: str) -> DataFrame:
    monthly = tables.site_series(spark, folder)
    return rounded(forecast.forecast_best(monthly, SITE, "t", "v", HORIZON, arima="search"))


def forecast_best(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast_best(tables.site_series(spark, folder), SITE, "t", "v", HORIZON, arima="closed_form"))


def forecast_guard_yearly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast_best(tables.site_years(spark, folder), SITE, "t", "v", 5, arima="closed_form"))


# Pathways and scenarios


def _placed(spark: SparkSession, folder: str, monthly: DataFrame, pathway: str) -> DataFrame:
    span = pathways.starts(monthly, SITE, "t", "v")
    wanted = [s for s in SCENARIOS if s["pathway"] == pathway]
    return pathways.resolve_targets(pathways.scenario_list(span, wanted)).filter(F.col("target_period") > F.col("start"))


def pathway(name: str, shape: Callable[..., Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        placed = _placed(spark, folder, tables.site_series(spark, folder), name)
        future = placed.withColumn("t", F.explode(F.sequence(F.col("start") + 1, F.col("target_period"))))
        path = shape(F.col("start"), F.col("current"), F.col("target_period"), F.col("target"), F.col("t"))
        return rounded(future.select("site", "scenario", "t", path.alias("path")))

    return run


def pathway_milestones(spark: SparkSession, folder: str) -> DataFrame:
    monthly = tables.site_series(spark, folder)
    placed = _placed(spark, folder, monthly, "milestones").filter(F.size("milestone_periods") > 0)
    return rounded(pathways.milestone_pathway(monthly, placed, SITE, "t", "v"))


def _scenario_paths(spark: SparkSession, folder: str) -> DataFrame:
    monthly = tables.site_series(spark, folder)
    return pathways.run_scenarios(monthly, SCENARIOS, SITE, "t", "v", arima="closed_form")


def scenario_gap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_scenario_paths(spark, folder).select("site", "scenario", "pathway", "t", "bau", "commitment", "gap", "model"))


def scenario_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pathways.scenario_summary(_scenario_paths(spark, folder), SITE))


def scenario_rejects(spark: SparkSession, folder: str) -> DataFrame:
    monthly = tables.site_series(spark, folder)
    return pathways.split_scenarios(monthly, SCENARIOS, SITE, "t", "v")[1]


# Policies


def _commitments(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.commitment_documents(spark, folder, broken=False)
    return policy.parse_commitments(docs, "text", SITE)


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    return policy.commitment_actions(tables.site_commitments(spark, folder), SITE)


def commitments_parse(spark: SparkSession, folder: str) -> DataFrame:
    actions = policy.commitment_actions(_commitments(spark, folder), SITE)
    return rounded(
        actions.select(
            "site",
            "entry",
            "action_idx",
            "sector",
            "action_name",
            "baseline_emissions_mtco2",
            "manual_share_pct",
            "reduction_target_pct",
            "removal_increase_pct",
            F.size("implementation_years").alias("n_knots"),
            "status",
        )
    )


def commitments_countries(spark: SparkSession, folder: str) -> DataFrame:
    return policy.list_countries(tables.commitment_documents(spark, folder), "text", SITE)


def commitment_targets(spark: SparkSession, folder: str) -> DataFrame:
    targets = policy.commitment_targets(_commitments(spark, folder))
    return rounded(targets.select("site", "entry", "mode", "forecast_mode", "target_year", "target_emissions_gtco2"))


def commitments_validate(spark: SparkSession, folder: str) -> DataFrame:
    return validation.validate(tables.commitment_documents(spark, folder), "text", SITE)


def commitment_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = validation.violations(tables.commitment_documents(spark, folder), "text", SITE)
    return found.groupBy("rule_no").agg(F.count(F.lit(1)).alias("n_violations"), F.min("site").alias("first_site"))


def mode_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    return policy.mode_mismatch(_commitments(spark, folder), "target").select("site", "entry", "mode")


def unsorted_years(spark: SparkSession, folder: str) -> DataFrame:
    return validation.unsorted_years(_actions(spark, folder), SITE).select("site", "action_idx", "sector")


def sector_share(spark: SparkSession, folder: str) -> DataFrame:
    shares = policy.action_shares(_actions(spark, folder), SITE)
    return rounded(shares.select("site", "sector", "share_pct"))


def share_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(policy.share_quality(policy.action_shares(_actions(spark, folder), SITE), SITE))


def sector_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(policy.sector_breakdown(_actions(spark, folder), SITE))


def sector_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(policy.sector_contributions(_actions(spark, folder), SITE))


def reduction_by_year(spark: SparkSession, folder: str) -> DataFrame:
    found = policy.reductions_by_year(_actions(spark, folder), *POLICY_YEARS)
    return rounded(found.select("site", "sector", "year", "reduction_pct"))


def reduction_by_year_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same with knots as rows and an as-of join."""
    actions, keys = _actions(spark, folder), [*SITE, "action_idx"]
    years = actions.select(*keys, F.explode(F.sequence(F.lit(POLICY_YEARS[0]), F.lit(POLICY_YEARS[1]))).alias("year"))
    found = policy.reductions_from_rows(actions, policy.knot_rows(actions, keys), years, keys)
    return rounded(found.select("site", "sector", "year", "reduction_pct"))


def discount_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Daily discounts of every site as thousands of knots, asked 45 days after each returned line: the days around it and the value between them."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01"))
    lines = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("site"), day.alias("day"), "l_discount", "l_returnflag")
    knots = lines.groupBy("site", "day").agg(F.avg(F.col("l_discount") * 100).alias("pct"))
    asked = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "site", (F.col("day") + 45).alias("day"))
    b, a = F.col("b"), F.col("a")
    between = b["pct"] + F.coalesce((a["pct"] - b["pct"]) * (F.col("day") - b["day"]) / (a["day"] - b["day"]), F.lit(0.0))
    found = asof.asof_join(asked, knots, SITE, "day", ["pct"], "b", "a")
    return rounded(found.select("l_orderkey", "l_linenumber", "l_partkey", "site", "day", b["day"].alias("day_before"), a["day"].alias("day_after"), between.alias("pct")))


def absolute_reduction(spark: SparkSession, folder: str) -> DataFrame:
    found = policy.reductions_by_year(_actions(spark, folder), *POLICY_YEARS)
    return rounded(found.select("site", "sector", "year", "absolute_reduction_mtco2"))


def annual_fraction(spark: SparkSession, folder: str) -> DataFrame:
    shares = policy.action_shares(_actions(spark, folder), SITE)
    return rounded(policy.annual_fraction(shares, SITE, *POLICY_YEARS).select("site", "year", "fraction"))


def data_gap(spark: SparkSession, folder: str) -> DataFrame:
    return policy.data_horizon(_actions(spark, folder), SITE)


def sector_progress(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(policy.progress_table(_actions(spark, folder), SITE).drop("action_idx"))


def sector_report(spark: SparkSession, folder: str) -> DataFrame:
    report = policy.sector_report(policy.action_shares(_actions(spark, folder), SITE), SITE)
    return rounded(report.drop("action_idx", "action_name"))


def annual_fraction_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Fractions of every country of documents that hold two each."""
    actions = policy.commitment_actions(_commitments(spark, folder), SITE)
    found = policy.annual_fraction(policy.action_shares(actions, SITE), SITE, *POLICY_YEARS)
    return rounded(found.select("site", "entry", "year", "fraction"))


def _policy_path(spark: SparkSession, folder: str, yearly: DataFrame) -> tuple[DataFrame, DataFrame]:
    shares = policy.action_shares(_actions(spark, folder), SITE)
    fractions = policy.annual_fraction(shares, SITE, 1996, POLICY_END).withColumnRenamed("year", "t")
    bau = forecast.forecast_best(yearly, SITE, "t", "v", arima="closed_form", until=POLICY_END)
    bau = bau.select("site", "t", F.col("forecast").alias("bau"))
    return bau, policy.policy_pathway(bau, fractions, pathways.starts(yearly, SITE, "t", "v"), SITE, "t", POLICY_UNIT)


def policy_pathway(spark: SparkSession, folder: str) -> DataFrame:
    """The policy-driven path with the target it is held against, which in forecast mode is the projected one."""
    bau, path = _policy_path(spark, folder, tables.site_years(spark, folder))
    commitment = columns.at_least(F.col("path"), 0.0)
    both = bau.join(path, ["site", "t"])
    return rounded(both.select("site", "t", "bau", commitment.alias("commitment"), (F.col("bau") - commitment).alias("gap"), "target"))


def scenario_policy(spark: SparkSession, folder: str) -> DataFrame:
    """A policy-driven scenario beside a straight one, for every site."""
    yearly = tables.site_years(spark, folder)
    _, path = _policy_path(spark, folder, yearly)
    wanted = [
        {"scenario": s, "pathway": p, "target_kind": "net_zero", "target_period": POLICY_END}
        for s, p in (("policies", "policy_driven"), ("straight", "linear"))
    ]
    rows = pathways.run_scenarios(yearly, wanted, SITE, "t", "v", policy_path=path, arima="closed_form")
    return rounded(rows.select("site", "scenario", "t", "bau", "commitment", "gap"))


# Process scoring


def score_points(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_points(tables.operating_points(spark, folder))
    return scored.select(
        "l_orderkey", "l_linenumber", "l_partkey", "primary_product", "yield_pct", "yield_range", "h2_per_co2",
        "carbon_util_pct", "temperature_score", "pressure_score", "h2_score", "operating_score",
    )


def product_slate(spark: SparkSession, folder: str) -> DataFrame:
    slate = scoring.slate_rows(scoring.score_points(tables.operating_points(spark, folder)), ["pathway"])
    return rounded(
        slate.groupBy("pathway", "product").agg(
            F.count(F.lit(1)).alias("n_points"),
            F.avg("selectivity_pct").alias("mean_pct"),
            F.max("selectivity_pct").alias("max_pct"),
        )
    )


def operating_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_points(tables.operating_points(spark, folder))
    return rounded(
        scored.groupBy("pathway").agg(F.avg("operating_score").alias("mean_score"), F.max("operating_score").alias("best_score"))
    )


def point_messages(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_points(tables.operating_points(spark, folder))
    texts = F.concat(
        F.transform("suggestions", lambda m: F.struct(F.lit("suggestion").alias("kind"), m.alias("message"))),
        F.transform("notes", lambda m: F.struct(F.lit("note").alias("kind"), m.alias("message"))),
    )
    rows = scored.select("pathway", F.inline(texts))
    return rows.groupBy("pathway", "kind", "message").agg(F.count(F.lit(1)).alias("n_points"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return explore.best_cells(tables.operating_points(spark, folder))


def catalyst_matrix(spark: SparkSession, folder: str) -> DataFrame:
    names = dict(zip(explore.CATALYST_COLUMNS, ["ni", "cu_zno", "fe_co", "ag_au", "cu_electro", "other"], strict=True))
    return explore.matrix(_cells(spark, folder)).select("pathway", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def matrix_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(explore.matrix_summary(_cells(spark, folder)))


def optimal_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return explore.optimal_conditions(_cells(spark, folder)).drop("pathway_pos")


def conditions_extremes(spark: SparkSession, folder: str) -> DataFrame:
    return explore.conditions_extremes(explore.optimal_conditions(_cells(spark, folder)))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return explore.grid_search(tables.process_units(spark, folder), ["unit"])


def grid_search_top10(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top_points(tables.process_units(spark, folder), ["unit"])


def grid_best_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    best = explore.best_points(_grid(spark, folder), ["unit"], TOP)
    return best.select("unit", "rank", "t_index", "p_index", "h_index", "yield_pct", "carbon_util_pct", "objective_score")


def grid_objectives(spark: SparkSession, folder: str) -> DataFrame:
    kinds = explore.kinds_of(explore.with_kinds(tables.process_units(spark, folder)), ["unit"])
    grid = explore.grid_search(kinds, ["_kind", "_first"])
    return rounded(
        grid.groupBy("primary_product").agg(
            F.max("yield_pct").alias("yield_pct"), *[F.max(f"sel_{s}").alias(f"sel_{s}") for s in PRODUCTS.values()]
        )
    )


def grid_selectivity_top10(spark: SparkSession, folder: str) -> DataFrame:
    best = explore.top_points(tables.process_units(spark, folder), ["unit"], objective="Maximize CH3OH selectivity")
    return best.select("unit", "t_index", "p_index", "h_index", "sel_ch3oh", "objective_score")


def grid_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return explore.heatmap(_grid(spark, folder), ["unit"])


# Training table, profile, folds


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return features.training_table(tables.experimental_log(spark, folder), tables.literature_log(spark, folder))


def training_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_training(spark, folder).withColumnRenamed("1000_T_K", "inv_t"))


def methanol_subset(spark: SparkSession, folder: str) -> DataFrame:
    subset = features.methanol_subset(_training(spark, folder))
    return rounded(
        subset.groupBy("catalyst_family").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("Y_MeOH").alias("mean_y_meoh"))
    )


def profile_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(_training(spark, folder), ["pathway"], "X_CO2"))


def profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(_training(spark, folder), "catalyst_family").orderBy(F.desc("n_rows"), "catalyst_family")


def profile_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.column_ranges(_training(spark, folder), ["temperature_c", "pressure_bar", "X_CO2", "Y_MeOH"]))


def profile_sources(spark: SparkSession, folder: str) -> DataFrame:
    return profile.source_counts(_training(spark, folder))


def profile_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct parts and quantiles of the temperature per pathway from the merged states of seven parts of the table, held against the table itself."""
    runs = tables.operating_points(spark, folder).withColumn("part", F.col("l_orderkey") % 7)
    shares = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    merged = sketches.merged(sketches.states(runs, ["pathway", "part"], "l_partkey", "temperature_c"), ["pathway"])
    return sketches.held_against(runs, sketches.estimates(merged, ["pathway"], shares), ["pathway"], "l_partkey", "temperature_c", shares)


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    runs = tables.operating_points(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "pathway", "temperature_c")
    return rounded(runs.orderBy("l_orderkey", "l_linenumber", "l_partkey", "temperature_c").limit(10))


def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    return features.label_codes(_training(spark, folder), list(features.LABELS))


def unknown_category(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.operating_points(spark, folder).select("pathway", "catalyst_family", "reactor_type")
    coded = features.encode_labels(points, features.label_indexer(_training(spark, folder)))
    return coded.groupBy("pathway", "catalyst_family", "reactor_type", *features.LABELS.values()).agg(
        F.count(F.lit(1)).alias("n_points")
    )


def standardise(spark: SparkSession, folder: str) -> DataFrame:
    numbers = ["temperature_c", "pressure_bar", "h2_co2_ratio", "ln_pressure"]
    scaled = features.standardise(_training(spark, folder), numbers)
    return rounded(scaled.select("pathway", "data_source", *[f"{c}_z" for c in numbers]), 7)


def fold_sizes(spark: SparkSession, folder: str) -> DataFrame:
    folded = ranks.contiguous_folds(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 5)
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    split = ranks.holdout_split(tables.table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])
    return split.groupBy("is_train").agg(F.count(F.lit(1)).alias("n_rows"))


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.operating_points(spark, folder)
    value = model.confidence(F.col("temperature_c"), F.col("pressure_bar"), F.col("h2_to_co2"))
    return rounded(points.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("confidence")))


def route_rules(spark: SparkSession, folder: str) -> DataFrame:
    routed = model.route_predictions(tables.operating_points(spark, folder), {})
    return rounded(
        routed.groupBy("model_used", "data_confidence", "pathway").agg(
            F.count(F.lit(1)).alias("n_points"), F.avg("yield_pct").alias("mean_yield")
        )
    )


# Models. The models of a table are trained once in a session, until the table's files change, and shared by the queries below.

ROW = ["l_orderkey", "l_linenumber"]
FOLDS = 5
SMALL = {"trees": 3, "depth": 3}  # of the models whose training has SQL


@cache
def _runs_of(spark: SparkSession, folder: str, version: str, folds: bool = False) -> DataFrame:
    use_checkpoint_dir(spark)
    runs = ranks.holdout_split(tables.labelled_runs(spark, folder), ROW)
    if folds:
        runs = model.in_folds(ranks.contiguous_folds(runs.withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "row", FOLDS), FOLDS)
    return runs.checkpoint()


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled runs with their side of the hold-out split, put together once."""
    return _runs_of(spark, folder, tables.version(spark, folder, "lineitem"))


@cache
def _trained(spark: SparkSession, folder: str, version: str, trees: int, depth: int, sides: bool, folds: bool) -> dict[str, model.Model]:
    jobs = {target: model.Job(target, "is_train") for target in model.TARGETS} if sides else {}
    jobs |= model.fold_jobs(model.TARGETS, FOLDS) if folds else {}
    return model.train_jobs(_runs_of(spark, folder, version, folds), jobs, trees, depth, ROW)


def _models(spark: SparkSession, folder: str, trees: int = model.TREES, depth: int = model.DEPTH, sides: bool = True, folds: bool = False) -> dict[str, model.Model]:
    """Both targets trained on the training side (`sides`) and on all folds but one (`folds`), those that a query asks for: models that grow in the same passes."""
    return _trained(spark, folder, tables.version(spark, folder, "lineitem"), trees, depth, sides, folds)


def gbt_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Figures on the training and the held-out rows, as the training saw them after its last round."""
    history = model.training_history(_models(spark, folder), spark).where(F.col("round") == model.TREES)
    return history.select(F.col("used").alias("is_train"), F.col("model").alias("target"), "n_rows", "r2", "rmse", "mae")


def gbt_importance(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _models(spark, folder)
    return model.feature_importance(fitted["X_CO2"], spark, "X_CO2", 8).unionByName(
        model.feature_importance(fitted["Y_MeOH"], spark, "Y_MeOH", 8)
    )


def gbt_learning_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Error after each boosting round, of both targets on the training and the held-out rows."""
    history = model.training_history(_models(spark, folder), spark).where("round > 0")
    return history.select(F.col("model").alias("target"), F.when(F.col("used"), "train").otherwise("test").alias("side"), "round", "rmse")


def gbt_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Five contiguous folds of both targets, each held against a model that did not see it."""
    folds = _models(spark, folder, sides=False, folds=True)
    return model.cross_validation_summary(model.held_out_metrics(folds, spark), ["target"])


def gbt_predict(spark: SparkSession, folder: str) -> DataFrame:
    return model.add_ml_predictions(tables.operating_points(spark, folder), _models(spark, folder)).select(
        "l_orderkey", "l_linenumber", "X_CO2", "Y_MeOH", "S_MeOH", "confidence"
    )


def route_predictions(spark: SparkSession, folder: str) -> DataFrame:
    routed = model.route_predictions(tables.operating_points(spark, folder), _models(spark, folder))
    return routed.groupBy("model_used", "data_confidence", "pathway").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("yield_pct").alias("mean_yield"), F.avg("carbon_util_pct").alias("mean_carbon")
    )


# The same scoring with SQL, and the same training and measuring with a few trees, for which there is SQL too.


def boost_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of both targets' models."""
    fitted = _models(spark, folder, **SMALL)
    nodes = fitted["X_CO2"].nodes("X_CO2").unionByName(fitted["Y_MeOH"].nodes("Y_MeOH"))
    return rounded(nodes.withColumn("n_rows", F.col("n_rows").cast("long")))


def boost_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Every point with its predictions by all trees of the whole models, held in 0..100, the selectivity and the confidence."""
    points = model.add_ml_predictions(tables.operating_points(spark, folder), _models(spark, folder))
    return rounded(points.select("l_orderkey", "l_linenumber", "l_partkey", "X_CO2", "Y_MeOH", "S_MeOH", "confidence"))


def boost_route(spark: SparkSession, folder: str) -> DataFrame:
    """Points by the way they were answered: methanol by all trees of the whole models, the others by rules."""
    routed = model.route_predictions(tables.operating_points(spark, folder), _models(spark, folder))
    return rounded(
        routed.groupBy("model_used", "data_confidence", "pathway", "primary_product").agg(
            F.count(F.lit(1)).alias("n_points"), F.avg("yield_pct").alias("mean_yield"), F.avg("carbon_util_pct").alias("mean_carbon")
        )
    )


def boost_importance(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _models(spark, folder, **SMALL)
    return rounded(model.feature_importance(fitted["X_CO2"], spark, "X_CO2").unionByName(model.feature_importance(fitted["Y_MeOH"], spark, "Y_MeOH")))


def boost_learning_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(model.learning_curves(_models(spark, folder, **SMALL), _runs(spark, folder), {t: t for t in model.TARGETS}, ["is_train"]))


def boost_report(spark: SparkSession, folder: str) -> DataFrame:
    """Training, hold-out and cross-validation figures of both targets, as the training saw them after its last round."""
    fitted = _models(spark, folder, **SMALL, folds=True)
    held_out = model.held_out_metrics({name: m for name, m in fitted.items() if name not in model.TARGETS}, spark)
    last = model.training_history({t: fitted[t] for t in model.TARGETS}, spark).where(F.col("round") == SMALL["trees"])
    sides = last.withColumnsRenamed({"model": "target", "used": "is_train"})
    return rounded(model.training_report(sides, model.cross_validation_summary(held_out, ["target"])))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        series_read_filter, regions_distinct, region_filter, nation_forecast,
        backtest_mape, arima_closed_form, arima_search, forecast_best, forecast_guard_yearly,
        pathway_milestones, scenario_gap, scenario_summary, scenario_rejects,
        commitments_parse, commitments_countries, commitment_targets, commitments_validate, commitment_violations,
        mode_mismatch, unsorted_years, sector_share, share_quality, sector_breakdown, sector_contributions,
        reduction_by_year, reduction_by_year_rows, discount_asof, absolute_reduction, annual_fraction, annual_fraction_entries, data_gap, sector_progress, sector_report, policy_pathway, scenario_policy,
        score_points, product_slate, operating_score, point_messages, catalyst_matrix, matrix_summary,
        optimal_conditions, conditions_extremes, grid_search_top10, grid_best_per_unit, grid_objectives,
        grid_selectivity_top10, grid_heatmap, training_table, methanol_subset, profile_describe, profile_counts,
        profile_ranges, profile_sources, profile_sketches, sample_rows, label_codes, unknown_category, standardise, fold_sizes,
        holdout_split, confidence, route_rules, gbt_metrics, gbt_importance, gbt_learning_curve, gbt_cross_validation, gbt_predict, route_predictions,
        boost_nodes, boost_predict, boost_route, boost_importance, boost_learning_curve, boost_report,
    ]
    shapes = {
        "linear": pathways.linear_pathway,
        "exponential": pathways.exponential_pathway,
        "scurve": pathways.scurve_pathway,
    }
    return {
        **{f.__name__: f for f in plain},
        **{f"poly_forecast_d{d}": poly_forecast(d) for d in (1, 2, 3, 4)},
        **{f"pathway_{name}": pathway(name, shape) for name, shape in shapes.items()},
    }
