"""Process constants as small local tables. Their row counts are fixed here, so joining them by
broadcast is safe at any data size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Pathway, primary product, base yield, stoichiometric H2 per CO2, then optimum and
# width for temperature (C), pressure (bar) and H2:CO2 ratio.
PATHWAYS = [
    ("Sabatier (methanation)", "CH4 (methane)", 0.72, 4.0, 320, 60, 10, 8, 4.0, 0.8),
    ("RWGS + Fischer-Tropsch", "C5+ hydrocarbons (diesel/jet range)", 0.55, 2.2, 380, 80, 20, 12, 2.0, 0.9),
    ("Methanol synthesis", "CH3OH (methanol)", 0.60, 3.0, 250, 40, 50, 20, 3.0, 0.8),
    ("Electroreduction (formate route)", "HCOO− / HCOOH (formate/formic acid)", 0.45, 2.0, 25, 15, 1, 0.8, 2.0, 0.8),
    ("Electroreduction (CO route)", "CO (syngas component)", 0.50, 1.0, 25, 15, 1, 0.8, 1.5, 0.6),
]

# What a pathway absent from the table gets (its score widths are half its windows, and it
# makes none of the named products).
UNKNOWN_PATHWAY = {
    "primary_product": "Unknown",
    "base_yield": 0.4,
    "h2_stoich": 2.0,
    "t_opt": 300.0,
    "t_width": 60.0,
    "p_opt": 10.0,
    "p_width": 8.0,
    "h_opt": 2.0,
    "h_width": 1.0,
    "t_sigma": 30.0,
    "p_sigma": 4.0,
    "h_sigma": 0.5,
    "made_const": 0.0,
    "made_temp": 0.0,
    "made_h2": 0.0,
}

# Product selectivity = constant + a * temperature score + b * (1 - temperature score) + c * H2 score.
SELECTIVITY = [
    ("Sabatier (methanation)", "CH4", 0.10, 0.75, 0.0, 0.10),
    ("Sabatier (methanation)", "CO", 0.0, 0.0, 0.10, 0.0),
    ("Sabatier (methanation)", "CH3OH", 0.0, 0.0, 0.0, 0.03),
    ("Sabatier (methanation)", "C5+", 0.02, 0.0, 0.0, 0.0),
    ("RWGS + Fischer-Tropsch", "C5+", 0.10, 0.55, 0.0, 0.10),
    ("RWGS + Fischer-Tropsch", "CO", 0.0, 0.0, 0.08, 0.0),
    ("RWGS + Fischer-Tropsch", "CH4", 0.0, 0.0, 0.0, 0.06),
    ("RWGS + Fischer-Tropsch", "CH3OH", 0.04, 0.0, 0.0, 0.0),
    ("Methanol synthesis", "CH3OH", 0.10, 0.70, 0.0, 0.10),
    ("Methanol synthesis", "CO", 0.0, 0.0, 0.06, 0.0),
    ("Methanol synthesis", "CH4", 0.0, 0.0, 0.0, 0.04),
    ("Methanol synthesis", "C5+", 0.02, 0.0, 0.0, 0.0),
    ("Electroreduction (formate route)", "HCOO/HCOOH", 0.05, 0.65, 0.0, 0.15),
    ("Electroreduction (formate route)", "CO", 0.0, 0.0, 0.08, 0.0),
    ("Electroreduction (formate route)", "CH3OH", 0.05, 0.0, 0.0, 0.0),
    ("Electroreduction (formate route)", "CH4", 0.02, 0.0, 0.0, 0.0),
    ("Electroreduction (CO route)", "CO", 0.05, 0.70, 0.0, 0.10),
    ("Electroreduction (CO route)", "HCOO/HCOOH", 0.0, 0.0, 0.06, 0.0),
    ("Electroreduction (CO route)", "CH3OH", 0.05, 0.0, 0.0, 0.0),
    ("Electroreduction (CO route)", "CH4", 0.02, 0.0, 0.0, 0.0),
]

# Catalyst family and its yield gain, in catalog order.
CATALYSTS = [
    ("Ni-based", 1.00),
    ("Cu/ZnO/Al2O3", 1.05),
    ("Fe/Co (FT)", 1.10),
    ("Ag/Au (electro)", 0.95),
    ("Cu (electro)", 1.08),
    ("Other", 1.00),
]

# Catalyst families by the kind of pathway they serve; "Other" serves both.
THERMAL_CATALYSTS = ["Ni-based", "Cu/ZnO/Al2O3", "Fe/Co (FT)", "Other"]
ELECTRO_CATALYSTS = ["Cu (electro)", "Ag/Au (electro)", "Other"]

# Reactor type and its bias.
REACTORS = [
    ("Fixed-bed", 1.00),
    ("Slurry", 0.98),
    ("Electrochemical (flow cell)", 1.05),
    ("Other", 1.00),
]

# Column-safe names of the products, in the order used for reports.
PRODUCTS = {"CH4": "ch4", "CO": "co", "CH3OH": "ch3oh", "C5+": "c5p", "HCOO/HCOOH": "hcoo"}


# Hint texts for a low score; optimum and half of the window are filled in per pathway.
HINTS = {
    "t": "Increase temperature toward ~{opt}°C (±{half}°C).",
    "p": "Increase pressure toward ~{opt} bar (±{half} bar).",
    "h": "Adjust H₂:CO₂ toward ~{opt}:1 (±{half}).",
}

# Smallest width (sigma) of the temperature, pressure and H2 scores.
SMALLEST_SIGMA = {"t": 10.0, "p": 2.0, "h": 0.4}


def hint(kind: str, optimum: float, width: float) -> str:
    if kind == "h":
        return HINTS[kind].format(opt=f"{optimum:.1f}", half=f"{width / 2:.1f}")
    return HINTS[kind].format(opt=int(optimum), half=int(width / 2))


UNKNOWN_PATHWAY |= {
    f"{kind}_hint": hint(kind, UNKNOWN_PATHWAY[f"{kind}_opt"], UNKNOWN_PATHWAY[f"{kind}_width"]) for kind in HINTS
}


def pathway_table(spark: SparkSession) -> DataFrame:
    """One row per pathway with its product, base yield, window and selectivity terms.

    `<k>_sigma` is the score width and `<k>_hint` the text for a low score, for k in t, p, h. A selectivity is linear in the two scores, so per
    product there is `<p>_const`, `<p>_temp` and `<p>_h2` (null where it is not made), and the same for
    `made`, the sum over the products.
    """
    names = ["base_yield", "h2_stoich", "t_opt", "t_width", "p_opt", "p_width", "h_opt", "h_width"]
    columns: dict[str, pa.Array] = {
        "pathway": pa.array([row[0] for row in PATHWAYS]),
        "pathway_pos": pa.array(range(len(PATHWAYS)), pa.int32()),
        "primary_product": pa.array([row[1] for row in PATHWAYS]),
    }
    for offset, name in enumerate(names, start=2):
        columns[name] = pa.array([float(row[offset]) for row in PATHWAYS], pa.float64())
    for kind, smallest in SMALLEST_SIGMA.items():
        widths = columns[f"{kind}_width"].to_pylist()
        columns[f"{kind}_sigma"] = pa.array([max(smallest, w / 2) for w in widths], pa.float64())
        optima = columns[f"{kind}_opt"].to_pylist()
        columns[f"{kind}_hint"] = pa.array([hint(kind, *pair) for pair in zip(optima, widths, strict=True)])
    linear = {(row[0], row[1]): (row[2] + row[4], row[3] - row[4], row[5]) for row in SELECTIVITY}
    for product, short in PRODUCTS.items():
        for term, name in enumerate(("const", "temp", "h2")):
            cells = [linear.get((row[0], product), (None, None, None))[term] for row in PATHWAYS]
            columns[f"{short}_{name}"] = pa.array(cells, pa.float64())
    for term, name in enumerate(("const", "temp", "h2")):
        sums = [sum(v[term] for (path, _), v in linear.items() if path == row[0]) for row in PATHWAYS]
        columns[f"made_{name}"] = pa.array(sums, pa.float64())
    return spark.createDataFrame(pa.table(columns))


def catalyst_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        pa.table(
            {
                "catalyst_family": [row[0] for row in CATALYSTS],
                "catalyst_pos": pa.array(range(len(CATALYSTS)), pa.int32()),
                "catalyst_gain": [row[1] for row in CATALYSTS],
            }
        )
    )


def reactor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        pa.table({"reactor_type": [row[0] for row in REACTORS], "reactor_bias": [row[1] for row in REACTORS]})
    )
