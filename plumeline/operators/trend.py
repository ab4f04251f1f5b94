"""Polynomial trend by least squares, for every series at once.

The fit uses polynomials that are orthogonal over the weighted points of the series (three-term
recurrence, Forsythe 1957). Each degree needs only sums over the key, so the whole chain runs as
windows over one partitioning, keeps full precision on raw years and needs no matrix solver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Periods are integers, so a polynomial that does not vanish on the points has a squared norm well above this.
RANK_TOLERANCE = 1e-6


def polynomial_trend(
    df: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    degree: int,
    fits: dict[str, str],
) -> DataFrame:
    """Adds one prediction column per fit, on every row.

    `fits` maps a boolean column (the rows that the fit uses) to the name of its prediction. Several
    fits share the same windows. With too few distinct periods the higher terms drop out; the column
    `<prediction>_degree` holds the degree that was used.
    """
    per_key = "OVER (PARTITION BY " + ", ".join(f"`{k}`" for k in keys) + ")"
    marks = list(enumerate(fits))

    def over_key(mark: str, expression: str, name: str) -> str:
        return f"sum(CASE WHEN `{mark}` THEN {expression} END) {per_key} AS {name}"

    # Degree 0: weight, centre and mean. The first polynomial is the distance from the centre.
    out = df.selectExpr(
        "*",
        *[over_key(m, "1D", f"_n0_{i}") for i, m in marks],
        *[over_key(m, f"CAST(`{time}` AS DOUBLE)", f"_s0_{i}") for i, m in marks],
        *[over_key(m, f"`{value}`", f"_t0_{i}") for i, m in marks],
    ).selectExpr(
        "*",
        *[f"CAST(`{time}` AS DOUBLE) - try_divide(_s0_{i}, _n0_{i}) AS _p1_{i}" for i, _ in marks],
        *[f"try_divide(_t0_{i}, _n0_{i}) AS _fit0_{i}" for i, _ in marks],
        *[f"1D AS _p0_{i}" for i, _ in marks],
        *[f"0 AS _degree0_{i}" for i, _ in marks],
    )
    for k in range(1, degree + 1):
        steps = []
        for i, _ in marks:
            p, before, norm = f"_p{k}_{i}", f"_p{k - 1}_{i}", f"_n{k}_{i}"
            usable = f"{norm} > {RANK_TOLERANCE}D"
            steps += [
                f"CASE WHEN {usable} THEN _fit{k - 1}_{i} + try_divide(_t{k}_{i}, {norm}) * {p} "
                f"ELSE _fit{k - 1}_{i} END AS _fit{k}_{i}",
                f"CASE WHEN {usable} THEN {k} ELSE _degree{k - 1}_{i} END AS _degree{k}_{i}",
            ]
            if k < degree:
                following = (
                    f"(_p1_{i} - try_divide(_s{k}_{i}, {norm})) * {p} - try_divide({norm}, _n{k - 1}_{i}) * {before}"
                )
                steps.append(f"CASE WHEN {usable} THEN {following} ELSE 0D END AS _p{k + 1}_{i}")
        out = out.selectExpr(
            "*",
            *[over_key(m, f"_p{k}_{i} * _p{k}_{i}", f"_n{k}_{i}") for i, m in marks],
            *[over_key(m, f"_p1_{i} * _p{k}_{i} * _p{k}_{i}", f"_s{k}_{i}") for i, m in marks],
            *[over_key(m, f"`{value}` * _p{k}_{i}", f"_t{k}_{i}") for i, m in marks],
        ).selectExpr("*", *steps)

    return out.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"_fit{degree}_{i} AS `{fits[m]}`" for i, m in marks],
        *[f"_degree{degree}_{i} AS `{fits[m]}_degree`" for i, m in marks],
    )
