"""Rule-based scoring of process operating points as column expressions over any number of rows.

A point has the columns `pathway, catalyst_family, temperature_c, pressure_bar, h2_to_co2,
reactor_type, grid_ci_gco2_per_kwh`; further columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.columns import at_least, at_most, clamp, gaussian_score, messages
from plumeline.functions.process_tables import (
    ELECTRO_CATALYSTS,
    PRODUCTS,
    THERMAL_CATALYSTS,
    UNKNOWN_PATHWAY,
    catalyst_table,
    pathway_table,
    reactor_table,
)

# The yield bounds before and after the corrections, the bounds of
# carbon use, the half-width and bounds of the yield range, and the grid carbon-intensity limits.
RAW_YIELD_BOUNDS = (0.05, 0.95)
YIELD_BOUNDS = (0.03, 0.95)
CARBON_BOUNDS = (0.02, 0.98)
RANGE_HALF_WIDTH, RANGE_LOW, RANGE_HIGH = 7.0, 3.0, 95.0
HIGH_GRID, LOW_GRID, CLEANER_GRID = 600.0, 100.0, 400.0
HIGH_GRID_FACTOR, LOW_GRID_FACTOR = 0.9, 1.03

# Message texts.
NOMINAL = "Operating point sits near nominal window."
CLEANER = "Use cleaner electricity (lower gCO₂/kWh) to improve net efficiency."
HIGH_GRID_NOTE = "High grid carbon intensity penalizes effective (net) efficiency for electro routes."
LOW_GRID_NOTE = "Low grid carbon intensity slightly improves effective (net) efficiency for electro routes."
DEFAULT_NOTE = "Heuristic demo output — replace with real kinetics/thermo + trained model for production."


def is_electro(pathway: Column) -> Column:
    return F.contains(pathway, F.lit("Electro"))


def is_valid_pair(pathway: Column, catalyst: Column) -> Column:
    """Thermal catalysts serve thermal pathways, electro catalysts electro pathways; unknown ones none."""
    return F.when(is_electro(pathway), catalyst.isin(ELECTRO_CATALYSTS)).otherwise(catalyst.isin(THERMAL_CATALYSTS))


def with_process_constants(points: DataFrame) -> DataFrame:
    """Looks the constants up by broadcast (tables of at most six rows) and fills the defaults."""
    spark = points.sparkSession
    joined = (
        points.join(F.broadcast(pathway_table(spark)), "pathway", "left")
        .join(F.broadcast(catalyst_table(spark)), "catalyst_family", "left")
        .join(F.broadcast(reactor_table(spark)), "reactor_type", "left")
    )
    return joined.withColumns(
        {
            **{name: F.coalesce(F.col(name), F.lit(default)) for name, default in UNKNOWN_PATHWAY.items()},
            "catalyst_gain": F.coalesce("catalyst_gain", F.lit(1.0)),
            "reactor_bias": F.coalesce("reactor_bias", F.lit(1.0)),
        }
    )


def grid_band(pathway: Column, grid: Column) -> Column:
    """A carbon intensity that gives the same yield as `grid`, one for each of the three cases; its suggestions and notes may differ."""
    electro = is_electro(pathway)
    return F.when(electro & (grid > HIGH_GRID), HIGH_GRID + 1.0).when(electro & (grid < LOW_GRID), LOW_GRID - 1.0).otherwise(HIGH_GRID)


def _score(kind: str, x: str) -> Column:
    return gaussian_score(F.col(x).cast("double"), F.col(f"{kind}_opt"), F.col(f"{kind}_sigma"))


def _selectivity(short: str) -> Column:
    return F.col(f"{short}_const") + F.col(f"{short}_temp") * F.col("_st") + F.col(f"{short}_h2") * F.col("_sh")


def score_points(points: DataFrame) -> DataFrame:
    """Adds the scores, yield, range, selectivities, carbon use, suggestions and notes to each point.

    A point without temperature, pressure or ratio has no yield: nulls stay null. Selectivity columns are null for products that the pathway does not make. Columns that a query
    does not use are pruned together with their expressions.
    """
    return score_joined(with_process_constants(points), points.columns)


def score_joined(joined: DataFrame, keep: list[str]) -> DataFrame:
    """`score_points` for rows that already carry their process constants; `keep` names the other columns."""
    shorts = list(PRODUCTS.values())
    rows = joined.withColumns(
        {
            "_st": _score("t", "temperature_c"),
            "_sp": _score("p", "pressure_bar"),
            "_sh": _score("h", "h2_to_co2"),
            "_electro": is_electro(F.col("pathway")),
        }
    )
    # The terms in the table keep every selectivity in 0..1 and their sum at most 1, so bounding them and
    # dividing by their sum with the rest would change nothing; only the rest needs a floor for rounding.
    # What is bounded becomes a column first: a bound reads its value several times, and a column is computed once.
    rows = rows.withColumn("_rest", F.lit(1.0) - _selectivity("made")).withColumn("_others", at_least(F.col("_rest"), 0.0))

    grid = F.col("grid_ci_gco2_per_kwh")
    raw = (
        F.col("base_yield")
        * F.col("catalyst_gain")
        * F.col("reactor_bias")
        * (F.lit(0.5) + F.lit(0.5) * F.col("_st"))
        * (F.lit(0.6) + F.lit(0.4) * F.col("_sp"))
        * (F.lit(0.5) + F.lit(0.5) * F.col("_sh"))
    )
    grid_factor = (
        F.when(F.col("_electro") & (grid > HIGH_GRID), HIGH_GRID_FACTOR)
        .when(F.col("_electro") & (grid < LOW_GRID), LOW_GRID_FACTOR)
        .otherwise(1.0)
    )
    rows = rows.withColumns({"_raw": raw, "_hydrogen": (F.col("h2_to_co2") + F.lit(1e-9)) / F.col("h2_stoich")})
    supplied = F.lit(0.8) + F.lit(0.2) * at_most(F.col("_hydrogen"), 1.0)
    rows = rows.withColumn("_made", clamp(F.col("_raw"), *RAW_YIELD_BOUNDS) * grid_factor * supplied).withColumn("_yield", clamp(F.col("_made"), *YIELD_BOUNDS))
    rows = rows.withColumns(
        {
            "yield_pct": F.round(F.lit(100.0) * F.col("_yield"), 1),
            "_used": F.col("_yield") * (F.lit(0.8) + F.lit(0.2) * (F.lit(1.0) - F.col("_others"))),
        }
    )
    carbon = clamp(F.col("_used"), *CARBON_BOUNDS)
    rows = rows.withColumns({"_low": F.round(F.col("yield_pct") - RANGE_HALF_WIDTH, 1), "_high": F.round(F.col("yield_pct") + RANGE_HALF_WIDTH, 1)})
    rows = rows.withColumns(
        {
            "yield_low": at_least(F.col("_low"), RANGE_LOW),
            "yield_high": at_most(F.col("_high"), RANGE_HIGH),
            "carbon_util_pct": F.round(F.lit(100.0) * carbon, 1),
            "h2_per_co2": F.round("h2_stoich", 2),
            "temperature_score": F.round("_st", 3),
            "pressure_score": F.round("_sp", 3),
            "h2_score": F.round("_sh", 3),
            **{f"sel_{s}": F.round(F.lit(100.0) * _selectivity(s), 1) for s in shorts},
            "sel_others": F.round(F.lit(100.0) * F.col("_others"), 1),
        }
    )
    suggestions = messages(
        (F.col("_st") < 0.5, F.col("t_hint")),
        ((F.col("_sp") < 0.5) & ~F.col("_electro"), F.col("p_hint")),
        (F.col("_sh") < 0.5, F.col("h_hint")),
        (F.col("_electro") & (grid > CLEANER_GRID), F.lit(CLEANER)),
        default=NOMINAL,
    )
    notes = messages(
        (F.col("_electro") & (grid > HIGH_GRID), F.lit(HIGH_GRID_NOTE)),
        (F.col("_electro") & (grid < LOW_GRID), F.lit(LOW_GRID_NOTE)),
        default=DEFAULT_NOTE,
    )
    return rows.select(
        *keep,
        "primary_product",
        "yield_pct",
        "yield_low",
        "yield_high",
        yield_range(F.col("yield_low"), F.col("yield_high")).alias("yield_range"),
        "h2_per_co2",
        "carbon_util_pct",
        "temperature_score",
        "pressure_score",
        "h2_score",
        operating_score().alias("operating_score"),
        *[f"sel_{s}" for s in [*shorts, "others"]],
        suggestions.alias("suggestions"),
        notes.alias("notes"),
        F.coalesce("pathway_pos", F.lit(-1)).alias("pathway_pos"),
        F.coalesce("catalyst_pos", F.lit(-1)).alias("catalyst_pos"),
    )


def yield_range(low: Column, high: Column) -> Column:
    """Both ends as text. They are rounded to one decimal, so their plain text shows exactly that."""
    return F.concat(low.cast("string"), F.lit("–"), high.cast("string"), F.lit("%"))


def operating_score() -> Column:
    """Mean of the three rounded scores, to three decimals."""
    return F.round((F.col("temperature_score") + F.col("pressure_score") + F.col("h2_score")) / 3.0, 3)


def _slate_entries() -> Column:
    names = [*PRODUCTS.items(), ("others", "others")]
    return F.array(*[F.struct(F.lit(n).alias("product"), F.col(f"sel_{s}").alias("selectivity_pct")) for n, s in names])


def slate_map() -> Column:
    """Selectivities of a scored point as a map of product to percent."""
    return F.map_from_entries(F.filter(_slate_entries(), lambda e: e["selectivity_pct"].isNotNull()))


def slate_rows(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per product that the pathway makes."""
    return scored.select(*keys, F.inline(_slate_entries())).filter(F.col("selectivity_pct").isNotNull())
