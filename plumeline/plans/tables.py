"""Series, policies, operating points and run logs derived from the warehouse tables.

The numbers have no physical meaning; the derivations give every operator whole tables to work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions.process_tables import CATALYSTS, PATHWAYS
from plumeline.operators.features import add_features
from plumeline.operators.scoring import score_points
from plumeline.operators.series import prepare

PATHWAY_NAMES = [row[0] for row in PATHWAYS]
CATALYST_NAMES = [row[0] for row in CATALYSTS]
SECTORS = ["AF", "AO", "NF", "NO", "RF", "RO"]
SINK_SECTOR = "NO"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> str:
    """Changes when the files of a table do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in system.listStatus(path)))


def month_index(date: str) -> Column:
    return (F.year(date) - 1995) * 12 + F.month(date)


def nation_series(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly order value per nation. Orders are summed per customer and month before the join, so a customer with very
    many orders joins as one row a month; the names are joined after the second sum, on a handful of rows."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        month_index("o_orderdate").alias("t"),
        (F.col("o_totalprice") / 1e6).alias("v"),
    )
    orders = orders.groupBy("c_custkey", "t").agg(F.sum("v").alias("v"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    monthly = prepare(orders.join(customers, "c_custkey").select("c_nationkey", "t", "v"), ["c_nationkey"], "t", "v")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return monthly.join(nations, "c_nationkey").select("n_name", "t", "v")


def shipments(spark: SparkSession, folder: str, period: Column) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"), period.alias("t"), (F.col("l_extendedprice") / 997.0).alias("v")
    )


def site_series(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly shipped value per supplier site."""
    return prepare(shipments(spark, folder, month_index("l_shipdate")), ["site"], "t", "v").select("site", "t", "v")


def site_years(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly shipped value per supplier site."""
    return prepare(shipments(spark, folder, F.year("l_shipdate")), ["site"], "t", "v").select("site", "t", "v")


def site_commitments(spark: SparkSession, folder: str) -> DataFrame:
    """One policy commitment per site with one action per sector (at most six).

    Lines are summed to (site, sector, year) before anything is collected, so an action array holds at
    most one knot per year and a commitment at most six actions.
    """
    yearly = (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("site"),
            F.concat("l_returnflag", "l_linestatus").alias("sector"),
            F.year("l_shipdate").alias("y"),
        )
        .agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("value"))
    )
    knot = F.when(F.col("y") >= 1996, F.struct("y", "q"))
    sectors = yearly.groupBy("site", "sector").agg(
        F.sum("value").alias("value"),
        F.sum(F.when(F.col("y") >= 1996, F.col("q"))).alias("total_q"),
        F.array_sort(F.collect_list(knot)).alias("knots"),
    )
    position = F.array_position(F.array(*[F.lit(s) for s in SECTORS]), F.col("sector")).cast("int")
    site = F.col("site").cast("int")
    sink = F.col("sector") == SINK_SECTOR
    aim = (site + F.col("pos")) % 4
    shares = F.transform(
        "knots",
        lambda _, i: F.aggregate(F.slice("knots", 1, i + 1), F.lit(0.0), lambda acc, k: acc + k["q"])
        / F.col("total_q")
        * 40.0,
    )
    backwards = site % 10 == 7

    def ordered(values: Column) -> Column:
        return F.when(backwards, F.reverse(values)).otherwise(values)

    action = F.struct(
        "sector",
        F.concat(F.lit("Programme "), F.col("sector")).alias("action_name"),
        F.lit(1995).alias("baseline_year"),
        (F.when(sink, -F.col("value")).otherwise(F.col("value")) / 9973.0).alias("baseline_emissions_mtco2"),
        F.when(site % 5 == 0, F.lit(20.0)).alias("share_pct"),
        F.when(aim == 0, F.lit(0.0)).when(aim == 2, F.lit(30.0)).when(aim == 3, F.lit(90.0)).alias("reduction_target_pct"),
        F.when(sink & (site % 3 == 0), F.lit(120.0)).alias("removal_increase_pct"),
        ordered(F.transform("knots", lambda k: k["y"])).alias("implementation_years"),
        ordered(shares).alias("yearly_improvement_pct"),
        F.element_at(F.array(F.lit("On track"), F.lit("Behind schedule"), F.lit("Ahead")), F.col("pos") % 3 + 1).alias(
            "status"
        ),
    )
    return (
        sectors.withColumn("pos", position)
        .withColumn("action", action)
        .groupBy("site")
        .agg(F.sum("value").alias("value"), F.array_sort(F.collect_list("action")).alias("policy_actions"))
        .select(
            "site",
            F.concat(F.lit("SITE_"), F.col("site").cast("string")).alias("country"),
            F.when(site % 3 == 0, F.lit("forecast")).when(site % 3 == 1, F.lit("target")).alias("mode"),
            F.lit(2030).alias("target_year"),
            F.lit(1995).alias("baseline_year"),
            (F.col("value") / 9999991.0).alias("baseline_emissions_gtco2"),
            F.when(site % 3 != 0, (F.lit(40) + site % 5 * 10).cast("double")).alias("target_reduction_pct"),
            "policy_actions",
        )
    )


def commitment_documents(spark: SparkSession, folder: str, broken: bool = True) -> DataFrame:
    """The commitments as JSON texts `(site, text)`, one per site.

    With `broken`, the site number decides what is wrong with a document: 1 a missing country field,
    2 an unknown mode, 3 arrays of unequal length, 4 a cut text, 5 a missing action field, 6 missing
    target fields, 7 a list instead of an object, 8 a stray entry; 0 is sound. Without, every document is sound and holds a
    second country with the same actions and half the baseline.
    """
    c = site_commitments(spark, folder)
    fault = (F.col("site") % 9 if broken else F.lit(0)).alias("fault")
    head = ["country", "mode", "target_year", "baseline_year", "baseline_emissions_gtco2", "target_reduction_pct"]
    whole = F.to_json(F.struct(*head))
    no_year = F.to_json(F.struct(*[h for h in head if h != "baseline_year"]))
    bad_mode = F.to_json(F.struct(*[F.lit("goal").alias("mode") if h == "mode" else F.col(h) for h in head]))
    keep_nulls = {"ignoreNullFields": "false"}
    actions = F.col("policy_actions")
    short = F.transform(
        actions,
        lambda a: a.withField(
            "yearly_improvement_pct", F.slice(a["yearly_improvement_pct"], 1, F.greatest(F.size(a["yearly_improvement_pct"]) - 1, F.lit(0)))
        ),
    )
    no_status = F.transform(actions, lambda a: a.dropFields("status"))
    head_text = F.when(F.col("fault") == 1, no_year).when(F.col("fault") == 2, bad_mode).otherwise(whole)
    action_text = (
        F.when(F.col("fault") == 3, F.to_json(short, keep_nulls))
        .when(F.col("fault") == 5, F.to_json(no_status, keep_nulls))
        .when(F.col("fault") == 6, F.to_json(actions))
        .otherwise(F.to_json(actions, keep_nulls))
    )
    opened = F.concat(F.lit('{"'), F.col("country"), F.lit('":'))
    inner = F.concat(F.substring(head_text, F.lit(1), F.length(head_text) - 1), F.lit(',"policy_actions":'), action_text)
    text = F.concat(opened, inner, F.lit("}}"))
    stray = F.concat(opened, inner, F.lit('},"_comments":{"description":"note"}}'))
    if not broken:
        twin = F.to_json(F.struct(*[F.col(h) if h != "baseline_emissions_gtco2" else (F.col(h) / 2).alias(h) for h in head[1:]]))
        named = F.concat(F.lit("TWIN_"), F.col("site").cast("string"))
        second = F.concat(F.lit(',"'), named, F.lit('":{"country":"'), named, F.lit('",'), F.substring(twin, F.lit(2), F.length(twin) - 2))
        text = F.concat(opened, inner, F.lit("}"), second, F.lit(',"policy_actions":'), action_text, F.lit("}}"))
    return c.select("*", fault).select(
        "site",
        F.when(F.col("fault") == 4, F.substring(text, F.lit(1), F.length(text) - 10))
        .when(F.col("fault") == 7, F.concat(F.lit("["), text, F.lit("]")))
        .when(F.col("fault") == 8, stray)
        .otherwise(text)
        .alias("text"),
    )


def _pick(number: Column, names: list[str]) -> Column:
    """The name at position `number`."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), number.cast("int") + 1)


POINT_PATHWAYS = [*PATHWAY_NAMES, "Plasma reforming"]
POINT_CATALYSTS = [*CATALYST_NAMES, "Hf-UiO-67-BA-Pt"]


def _reactor(flag: Column) -> Column:
    return F.when(flag == "A", "Fixed-bed").when(flag == "N", "Slurry").otherwise("Electrochemical (flow cell)")


def operating_points(spark: SparkSession, folder: str) -> DataFrame:
    """One operating point per order line."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        _pick(F.col("l_partkey") % 6, POINT_PATHWAYS).alias("pathway"),
        _pick(F.col("l_partkey") % 7, POINT_CATALYSTS).alias("catalyst_family"),
        (F.lit(20.0) + F.lit(8.0) * F.col("l_quantity")).alias("temperature_c"),
        (F.lit(1.0) + F.lit(500.0) * F.col("l_discount")).alias("pressure_bar"),
        (F.lit(1.0) + F.lit(50.0) * F.col("l_tax")).alias("h2_to_co2"),
        _reactor(F.col("l_returnflag")).alias("reactor_type"),
        (F.lit(18.0) * (F.col("l_suppkey") % 50)).alias("grid_ci_gco2_per_kwh"),
    )


def process_units(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per part with the ranges seen on its order lines."""
    points = operating_points(spark, folder)
    return (
        points.groupBy(F.col("l_partkey").alias("unit"), "pathway", "catalyst_family")
        .agg(
            F.max("reactor_type").alias("reactor_type"),
            *[
                f(c).alias(f"{k}_{n}")
                for k, c in (("t", "temperature_c"), ("p", "pressure_bar"), ("h", "h2_to_co2"))
                for n, f in (("min", F.min), ("max", F.max))
            ],
        )
        .withColumn("grid_ci_gco2_per_kwh", F.lit(18.0) * (F.col("unit") % 50))
    )


def _run_columns() -> list[Column]:
    return [
        "l_orderkey",
        "l_linenumber",
        (F.lit(20.0) + F.lit(8.0) * F.col("l_quantity")).alias("temperature_c"),
        (F.lit(1.0) + F.lit(500.0) * F.col("l_discount")).alias("pressure_bar"),
        (F.lit(1.0) + F.lit(50.0) * F.col("l_tax")).alias("h2_co2_ratio"),
        _reactor(F.col("l_returnflag")).alias("reactor_type"),
        (F.col("l_extendedprice") / 1100.0).alias("X_CO2"),
    ]


def experimental_log(spark: SparkSession, folder: str) -> DataFrame:
    """Open order lines as experimental runs."""
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_linestatus") == "O")
        .select(
            *_run_columns(),
            _pick(F.col("l_suppkey") % 2, ["Hf", "Zr"]).alias("metal"),
            _pick(F.col("l_partkey") % 2, ["BA", "FA"]).alias("linker"),
            (F.lit(20.0) + F.col("l_quantity")).alias("S_MeOH"),
            (F.lit(75.0) - F.col("l_quantity")).alias("S_CO"),
            F.lit(5.0).alias("S_CH4"),
        )
    )


def literature_log(spark: SparkSession, folder: str) -> DataFrame:
    """Finished order lines as literature runs."""
    kind = F.col("l_partkey") % 5
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_linestatus") == "F")
        .select(
            *_run_columns(),
            _pick(kind, PATHWAY_NAMES).alias("pathway"),
            _pick(kind, CATALYST_NAMES).alias("catalyst_family"),
            _pick(kind, [row[1] for row in PATHWAYS]).alias("primary_product"),
            (F.lit(50.0) + F.col("l_quantity")).alias("S_product"),
        )
    )


def labelled_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as training rows: conversion from the rule-based yield plus a repeatable disturbance."""
    scored = score_points(operating_points(spark, folder))
    disturbance = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11 - 5) / 10.0
    converted = F.greatest(F.least(F.col("yield_pct") * 1.2 + disturbance, F.lit(100.0)), F.lit(0.0))
    methanol = F.col("pathway") == "Methanol synthesis"
    return add_features(scored.withColumnRenamed("h2_to_co2", "h2_co2_ratio")).select(
        "l_orderkey",
        "l_linenumber",
        "pathway",
        "catalyst_family",
        "reactor_type",
        "temperature_c",
        "pressure_bar",
        "h2_co2_ratio",
        "1000_T_K",
        "temp_pressure",
        "ln_pressure",
        "is_thermal",
        "is_methanation",
        "is_methanol",
        converted.alias("X_CO2"),
        F.when(methanol, F.col("yield_pct")).otherwise(0.0).alias("Y_MeOH"),
    )
