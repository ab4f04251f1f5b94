"""Catalyst and pathway comparison, best conditions and grid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeline.functions.columns import axis, one_decimal, whole
from plumeline.functions.process_tables import CATALYSTS, PATHWAYS, PRODUCTS, pathway_table
from plumeline.operators.scoring import grid_band, is_electro, is_valid_pair, score_joined, score_points, with_process_constants
from plumeline.session import spread, use_checkpoint_dir

CATALYST_COLUMNS = [name for name, _ in CATALYSTS]

# Reactor and grid intensity assumed for the catalog points.
CATALOG_REACTOR = {"electro": "Electrochemical (flow cell)", "thermal": "Fixed-bed"}
CATALOG_GRID = {"electro": 50.0, "thermal": 0.0}

BOUNDS = ["t_min", "t_max", "p_min", "p_max", "h_min", "h_max"]
GRID_COLUMNS = ["t_index", "p_index", "h_index", "temperature_c", "pressure_bar", "h2_to_co2"]

OBJECTIVES = {
    "Maximize yield": "yield_pct",
    "Maximize CH3OH selectivity": "sel_ch3oh",
    "Maximize CH4 selectivity": "sel_ch4",
    "Maximize CO selectivity": "sel_co",
    "Maximize C5+ selectivity": "sel_c5p",
    "Maximize HCOO/HCOOH selectivity": "sel_hcoo",
}


def catalog_points(spark: SparkSession) -> DataFrame:
    """Every pathway at its optimum with every catalyst that serves it (5 pathways, 6 catalysts)."""
    pathways = pathway_table(spark)
    electro = is_electro(F.col("pathway"))
    catalysts = F.array(*[F.lit(name) for name in CATALYST_COLUMNS])
    return pathways.select(
        "pathway",
        F.explode(catalysts).alias("catalyst_family"),
        F.col("t_opt").alias("temperature_c"),
        F.col("p_opt").alias("pressure_bar"),
        F.col("h_opt").alias("h2_to_co2"),
        F.when(electro, CATALOG_REACTOR["electro"]).otherwise(CATALOG_REACTOR["thermal"]).alias("reactor_type"),
        F.when(electro, CATALOG_GRID["electro"]).otherwise(CATALOG_GRID["thermal"]).alias("grid_ci_gco2_per_kwh"),
    )


def best_cells(points: DataFrame) -> DataFrame:
    """Highest yield per valid (pathway, catalyst) pair. At most one row per pair leaves each task."""
    scored = score_points(points.filter(is_valid_pair(F.col("pathway"), F.col("catalyst_family"))))
    return scored.groupBy("pathway", "pathway_pos", "catalyst_family", "catalyst_pos", "primary_product").agg(
        F.max("yield_pct").alias("yield_pct")
    )


def matrix(cells: DataFrame) -> DataFrame:
    """Pathways as rows, catalysts as columns, null for pairs that are invalid or not observed."""
    return (
        cells.filter(F.col("pathway_pos") >= 0)
        .groupBy("pathway")
        .pivot("catalyst_family", CATALYST_COLUMNS)
        .agg(F.max("yield_pct"))
    )


def matrix_summary(cells: DataFrame) -> DataFrame:
    """Best pair (first catalyst, then first pathway, on ties), mean yield, and valid against all cells."""
    best = F.max(
        F.struct(
            F.col("yield_pct").alias("y"),
            (-F.col("catalyst_pos")).alias("c"),
            (-F.col("pathway_pos")).alias("p"),
            F.col("pathway").alias("pathway"),
            F.col("catalyst_family").alias("catalyst"),
        )
    )
    return (
        cells.filter((F.col("pathway_pos") >= 0) & (F.col("catalyst_pos") >= 0))
        .agg(
            best.alias("best"),
            F.avg("yield_pct").alias("mean_yield"),
            F.count("yield_pct").alias("valid_cells"),
        )
        .select(
            F.col("best.pathway").alias("best_pathway"),
            F.col("best.catalyst").alias("best_catalyst"),
            F.col("best.y").alias("best_yield"),
            "mean_yield",
            "valid_cells",
            F.lit(len(PATHWAYS) * len(CATALYSTS)).alias("total_cells"),
        )
    )


def optimal_conditions(cells: DataFrame) -> DataFrame:
    """Per pathway: its window as text, best catalyst (first in the catalog on ties), yield and product."""
    first_best = F.struct(F.col("yield_pct").alias("y"), (-F.col("catalyst_pos")).alias("c"))
    best = cells.groupBy("pathway").agg(
        F.max_by("catalyst_family", first_best).alias("best_catalyst"), F.max("yield_pct").alias("max_yield")
    )
    windows = pathway_table(cells.sparkSession)

    def around(kind: str) -> Column:
        return F.concat(whole(F.col(f"{kind}_opt")), F.lit("±"), whole(F.col(f"{kind}_width") / 2.0))

    ratio = F.concat(one_decimal(F.col("h_opt")), F.lit("±"), one_decimal(F.col("h_width") / 2.0))
    return best.join(F.broadcast(windows), "pathway").select(
        "pathway",
        "pathway_pos",
        around("t").alias("temperature_range"),
        around("p").alias("pressure_range"),
        ratio.alias("h2_ratio_range"),
        "best_catalyst",
        "max_yield",
        "primary_product",
    )


def conditions_extremes(conditions: DataFrame) -> DataFrame:
    """The rows of highest and lowest yield (first pathway on ties)."""
    row = F.struct("pathway", "max_yield", "best_catalyst", "primary_product")
    high = F.max_by(row, F.struct(F.col("max_yield").alias("y"), (-F.col("pathway_pos")).alias("p")))
    low = F.min_by(row, F.struct(F.col("max_yield").alias("y"), F.col("pathway_pos").alias("p")))
    both = conditions.agg(high.alias("high"), low.alias("low"))
    return both.select(
        F.inline(
            F.array(
                F.struct(F.lit("highest").alias("which"), F.col("high").alias("row")),
                F.struct(F.lit("lowest").alias("which"), F.col("low").alias("row")),
            )
        )
    ).select("which", "row.*")


def grid_points(units: DataFrame, steps: tuple[int, int, int]) -> DataFrame:
    """The T x P x H grid of every unit as points with their axis indexes.

    `units` carries `t_min, t_max, p_min, p_max, h_min, h_max` and the other point columns. Each unit
    row is exploded in place, so the grid needs no join and no shuffle.
    """
    kept = [c for c in units.columns if c not in BOUNDS]
    return (
        units.withColumn("_t", F.explode(axis(F.col("t_min"), F.col("t_max"), steps[0])))
        .withColumn("_p", F.explode(axis(F.col("p_min"), F.col("p_max"), steps[1])))
        .withColumn("_h", F.explode(axis(F.col("h_min"), F.col("h_max"), steps[2])))
        .select(
            *kept,
            F.col("_t.index").alias("t_index"),
            F.col("_p.index").alias("p_index"),
            F.col("_h.index").alias("h_index"),
            F.col("_t.value").alias("temperature_c"),
            F.col("_p.value").alias("pressure_bar"),
            F.col("_h.value").alias("h2_to_co2"),
        )
    )


def grid_search(units: DataFrame, keys: list[str], steps: tuple[int, int, int] = (7, 7, 7), objective: str = "Maximize yield") -> DataFrame:
    """All grid points of all units, scored, with `objective_score` (0 where the product is not made).

    The units are hashed by key and looked up before each becomes its grid, so the many grid rows are
    never shuffled: a ranking or a heat map per unit finds them in place.
    """
    grid = grid_points(with_process_constants(spread(units, *keys)), steps)
    scored = score_joined(grid, [*keys, *GRID_COLUMNS])
    return scored.select(
        *keys,
        "t_index",
        "p_index",
        "h_index",
        F.round("temperature_c", 3).alias("temperature_c"),
        F.round("pressure_bar", 3).alias("pressure_bar"),
        F.round("h2_to_co2", 3).alias("h2_to_co2"),
        "yield_pct",
        "yield_range",
        "primary_product",
        "carbon_util_pct",
        *[F.coalesce(f"sel_{s}", F.lit(0.0)).alias(f"sel_{s}") for s in PRODUCTS.values()],
        F.coalesce(F.col(OBJECTIVES[objective]), F.lit(0.0)).alias("objective_score"),
    )


def with_kinds(units: DataFrame) -> DataFrame:
    """The units, kept, with their `_kind`: all that the grid of a unit depends on. Units of one kind have the same grid."""
    use_checkpoint_dir(units.sparkSession)
    band = grid_band(F.col("pathway"), F.col("grid_ci_gco2_per_kwh")).alias("grid_ci_gco2_per_kwh")
    return units.withColumn("_kind", F.struct("pathway", "catalyst_family", "reactor_type", band, *BOUNDS)).checkpoint()


def kinds_of(units: DataFrame, keys: list[str]) -> DataFrame:
    """A row per kind that can stand for its units in `grid_search`, and its first unit. With both as keys the kinds are dealt out anew; by the kind alone they would stay in the few tasks of this sum."""
    return units.groupBy("_kind").agg(F.min(F.struct(*keys)).alias("_first")).select("_kind", "_kind.*", "_first")


def grid_order() -> list[Column]:
    return [F.desc("objective_score"), F.asc("t_index"), F.asc("p_index"), F.asc("h_index")]


def best_points(grid: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The best `top` points of every unit. A group holds one unit's grid, whose size is fixed by the steps."""
    ranked = grid.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*grid_order())))
    return ranked.filter(F.col("rank") <= top)


def best_overall(grid: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The best `top` points over all units: each task keeps its own best rows and sends only those."""
    return grid.orderBy(*grid_order(), *keys).limit(top)


def top_points(
    units: DataFrame, keys: list[str], steps: tuple[int, int, int] = (7, 7, 7), objective: str = "Maximize yield", top: int = 10
) -> DataFrame:
    """`best_overall` of the grids of all units. The ranking computes nothing but the objective, and that once per kind of unit. Of the best points, with a kind's first unit
    for all of its units, `top` are enough: every point before them brings at least that unit. Texts, carbon use and selectivities follow for the grids of the few units (at most `top`) that are in it."""
    place = ["t_index", "p_index", "h_index"]
    units = with_kinds(units)
    ranked = grid_search(kinds_of(units, keys), ["_kind", "_first"], steps, objective).select("_kind", "_first", *place, "objective_score")
    few_kinds = best_overall(ranked, ["_first"], top).select("_kind", *place, "objective_score")
    best = best_overall(units.select(*keys, "_kind").join(F.broadcast(few_kinds), "_kind"), keys, top).select(*keys, *place)
    few = units.drop("_kind").join(F.broadcast(best.select(*keys).distinct()), keys, "left_semi")
    found = grid_search(few, keys, steps, objective).join(F.broadcast(best), [*keys, *place], "left_semi")
    return best_overall(found, keys, top)


def heatmap(grid: DataFrame, keys: list[str], steps: tuple[int, int, int] = (7, 7, 7)) -> DataFrame:
    """Highest yield by temperature row and pressure column at the middle H2 index."""
    middle = grid.filter(F.col("h_index") == steps[2] // 2)
    cells = [
        F.max(F.when(F.col("p_index") == i, F.col("yield_pct"))).alias(f"p_{i}") for i in range(steps[1])
    ]
    return middle.groupBy(*keys, "t_index", "temperature_c").agg(*cells)

