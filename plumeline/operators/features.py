"""The training table: run logs, product columns, derived features, label codes and standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.operators.ranks import numbered
from plumeline.sources.series import cell, read_csv_text

# Column order of the training table, the features in model order, and the texts that
# name the experimental catalysts and product.
RUN_COLUMNS = [
    "pathway",
    "catalyst_family",
    "metal",
    "linker",
    "temperature_c",
    "pressure_bar",
    "h2_co2_ratio",
    "reactor_type",
    "X_CO2",
    "S_MeOH",
    "S_CO",
    "S_CH4",
    "Y_MeOH",
    "primary_product",
    "data_source",
]
DERIVED_COLUMNS = ["1000_T_K", "temp_pressure", "ln_pressure", "is_thermal", "is_methanation", "is_methanol"]
FEATURES = [
    "pathway_encoded",
    "catalyst_encoded",
    "reactor_encoded",
    "temperature_c",
    "pressure_bar",
    "h2_co2_ratio",
    "1000_T_K",
    "temp_pressure",
    "ln_pressure",
    "is_thermal",
    "is_methanation",
    "is_methanol",
]
LABELS = {"pathway": "pathway_encoded", "catalyst_family": "catalyst_encoded", "reactor_type": "reactor_encoded"}
EXPERIMENTAL_PATHWAY, EXPERIMENTAL_PRODUCT = "Methanol synthesis", "CH3OH (methanol)"

TEXT_COLUMNS = ["pathway", "catalyst_family", "metal", "linker", "reactor_type", "primary_product", "data_source"]

MOST_BROADCAST = 100_000  # labels of all columns together that are sent to the tasks


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A run log from CSV, experimental or literature: texts stay texts, every other column is a number."""
    raw = read_csv_text(spark, path)
    return raw.select(*[cell(c, "string" if c in TEXT_COLUMNS else "double").alias(c) for c in raw.columns])


def experimental_runs(runs: DataFrame) -> DataFrame:
    """Run log rows with the composed catalyst name and the methanol yield X*S/100."""
    return runs.select(
        F.lit(EXPERIMENTAL_PATHWAY).alias("pathway"),
        F.concat(F.col("metal"), F.lit("-UiO-67-"), F.col("linker"), F.lit("-Pt")).alias("catalyst_family"),
        "metal",
        "linker",
        "temperature_c",
        "pressure_bar",
        "h2_co2_ratio",
        "reactor_type",
        "X_CO2",
        "S_MeOH",
        "S_CO",
        "S_CH4",
        (F.col("X_CO2") * F.col("S_MeOH") / 100.0).alias("Y_MeOH"),
        F.lit(EXPERIMENTAL_PRODUCT).alias("primary_product"),
        F.lit("experimental").alias("data_source"),
    )


def literature_runs(runs: DataFrame) -> DataFrame:
    """Literature rows with the yield of their own product, X*S/100."""
    return runs.withColumn("Y_product", F.col("X_CO2") * F.col("S_product") / 100.0)


def align_literature(runs: DataFrame) -> DataFrame:
    """Routes the product columns by pathway (first match wins) into the columns of the training table."""

    def has(text: str) -> Column:
        return F.contains(F.col("pathway"), F.lit(text))

    route = (
        F.when(has("methanation"), "CH4")
        .when(has("Methanol"), "MeOH")
        .when(has("formate"), "none")
        .when(has("CO route"), "CO")
        .otherwise("none")
    )

    def routed(product: str, source: str) -> Column:
        return F.when(F.col("_route") == product, F.col(source)).otherwise(0.0)

    return runs.withColumn("_route", route).select(
        "pathway",
        "catalyst_family",
        F.lit("N/A").alias("metal"),
        F.lit("N/A").alias("linker"),
        "temperature_c",
        "pressure_bar",
        "h2_co2_ratio",
        "reactor_type",
        "X_CO2",
        routed("MeOH", "S_product").alias("S_MeOH"),
        routed("CO", "S_product").alias("S_CO"),
        routed("CH4", "S_product").alias("S_CH4"),
        routed("MeOH", "Y_product").alias("Y_MeOH"),
        "primary_product",
        F.lit("literature").alias("data_source"),
    )


def add_features(df: DataFrame) -> DataFrame:
    t, p, pathway = F.col("temperature_c"), F.col("pressure_bar"), F.col("pathway")
    return df.withColumns(
        {
            "1000_T_K": F.lit(1000.0) / (t + F.lit(273.15)),
            "temp_pressure": t * p,
            "ln_pressure": F.log(p + F.lit(1)),
            "is_thermal": (~F.contains(pathway, F.lit("Electro"))).cast("int"),
            "is_methanation": F.contains(pathway, F.lit("methanation")).cast("int"),
            "is_methanol": F.contains(pathway, F.lit("Methanol")).cast("int"),
        }
    )


def training_table(experimental: DataFrame, literature: DataFrame) -> DataFrame:
    """Experimental and literature runs in one table with the derived features."""
    return add_features(experimental_runs(experimental).unionByName(align_literature(literature_runs(literature))))


def methanol_subset(table: DataFrame) -> DataFrame:
    return table.filter((F.col("pathway") == EXPERIMENTAL_PATHWAY) & (F.col("data_source") == "experimental"))


def read_training_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The table back from CSV; the text N/A reads as null."""
    raw = read_csv_text(spark, path)
    whole = ["is_thermal", "is_methanation", "is_methanol"]
    kind = {**dict.fromkeys(TEXT_COLUMNS, "string"), **dict.fromkeys(whole, "int")}
    return raw.select(*[cell(c, kind.get(c, "double")).alias(c) for c in (*RUN_COLUMNS, *DERIVED_COLUMNS)])


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows `(column_name, label, code)`: the distinct labels of each column in sorted order, from 0.

    One pass over the table, reduced to the distinct labels, which are then ranked by ranges: no task holds all labels of a column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label")) for c in columns])
    distinct = df.select(F.inline(pairs)).filter(F.col("label").isNotNull()).distinct()
    ranked = numbered(distinct, ["column_name"], ["label"])
    return ranked.select("column_name", "label", F.col("number").cast("int").alias("code"))


def label_indexer(df: DataFrame) -> DataFrame:
    """The codes of a training table's label columns, kept, to be joined to other tables."""
    return label_codes(df, list(LABELS)).checkpoint()


def encode_labels(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds the code columns by joins with `codes`, of any number of labels: when any label of a row is unknown, all of its codes are 0.

    Up to `MOST_BROADCAST` labels are sent to the tasks, so the rows stay where they are; beyond that the joins shuffle."""
    small = codes.count() <= MOST_BROADCAST
    for column, coded in LABELS.items():
        own = codes.where(F.col("column_name") == column).select(F.col("label").alias(f"_label_{coded}"), F.col("code").alias(f"_{coded}"))
        df = df.join(F.broadcast(own) if small else own, F.col(f"`{column}`") == F.col(f"_label_{coded}"), "left").drop(f"_label_{coded}")
    known = reduce(Column.__and__, [F.col(f"_{c}").isNotNull() for c in LABELS.values()])
    return df.withColumns({c: F.when(known, F.col(f"_{c}")).otherwise(0) for c in LABELS.values()}).drop(*[f"_{c}" for c in LABELS.values()])


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `<column>_z` with zero mean and unit population deviation (a constant column only loses its
    mean). The means and deviations are one aggregated row."""
    moments = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*moments).first()
    scaled = {
        f"{c}_z": (F.col(f"`{c}`") - F.lit(row[f"m_{i}"])) / F.lit(row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)
    }
    return df.withColumns(scaled)
