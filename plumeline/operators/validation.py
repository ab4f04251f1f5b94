"""Checks of policy documents: every broken rule as a row, and the first one per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.columns import said

# Required fields in the order in which they are checked, and the accepted modes.
COUNTRY_FIELDS = ["country", "target_year", "baseline_year", "baseline_emissions_gtco2", "policy_actions"]
ACTION_FIELDS = [
    "sector",
    "action_name",
    "baseline_year",
    "baseline_emissions_mtco2",
    "implementation_years",
    "yearly_improvement_pct",
    "status",
]
MODES = ["forecast", "target"]

# The texts of the rules.
VALID = "JSON is valid"
BAD_SYNTAX = "Invalid JSON syntax"
NOT_AN_OBJECT = "JSON must be an object with country names as keys"
MISSING_FIELD = "Country '{country}' missing required field: {field}"
NO_TARGET = "Country '{country}' in target mode must have 'target_reduction_pct'"
BAD_MODE = "Country '{country}' has invalid mode '{mode}' (must be 'forecast' or 'target')"
NOT_AN_ARRAY = "Country '{country}' policy_actions must be an array"
MISSING_ACTION_FIELD = "Country '{country}' action {action} missing field: {field}"
NO_ACTION_TARGET = (
    "Country '{country}' action {action} ({sector}): must have either 'reduction_target_pct' or 'removal_increase_pct'"
)
SINK_TARGET = (
    "Country '{country}' action {action} ({sector}): "
    "sink sectors should use 'removal_increase_pct' instead of 'reduction_target_pct'"
)
UNEQUAL_ARRAYS = (
    "Country '{country}' action {action} ({sector}): "
    "implementation_years and yearly_improvement_pct must have same length"
)

WRONG_TYPE = "Validation error: country '{country}' action {action}: {field} is not {wanted}"

VIOLATION = "array<struct<action_idx:int,rule_no:int,message:string>>"


def _rule(action_idx: Column, number: int, broken: Column, message: Column) -> Column:
    found = F.struct(
        action_idx.cast("int").alias("action_idx"), F.lit(number).alias("rule_no"), message.alias("message")
    )
    return F.when(broken, found)


def _broken(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull()).cast(VIOLATION)


def _keys_of(body: Column) -> Column:
    return F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))


def _document_rules(text: str) -> Column:
    parsed = F.expr(f"try_parse_json(`{text}`)")
    shape = F.expr(f"schema_of_variant(try_parse_json(`{text}`))")
    nowhere = F.lit(-1)
    return _broken(
        _rule(nowhere, 0, parsed.isNull(), F.lit(BAD_SYNTAX)),
        _rule(
            nowhere,
            0,
            parsed.isNotNull() & ~F.startswith(shape, F.lit("OBJECT")),
            F.lit(NOT_AN_OBJECT),
        ),
    )


def _country_rules() -> Column:
    country, nowhere = F.col("entry"), F.lit(-1)

    def has(field: str) -> Column:
        return F.array_contains("_fields", field)

    mode = F.when(has("mode"), F.get_json_object("body", "$.mode")).otherwise(F.lit("target"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("body"), "$.policy_actions", "variant"))
    listed = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    shown = F.coalesce(mode, F.lit("None"))
    rules = [
        _rule(nowhere, 1 + i, ~has(f), said(MISSING_FIELD, country=country, field=F.lit(f)))
        for i, f in enumerate(COUNTRY_FIELDS)
    ]
    rules += [
        _rule(nowhere, 6, (mode == "target") & ~has("target_reduction_pct"), said(NO_TARGET, country=country)),
        _rule(nowhere, 7, mode.isNull() | ~mode.isin(MODES), said(BAD_MODE, country=country, mode=shown)),
        _rule(nowhere, 8, has("policy_actions") & ~listed, said(NOT_AN_ARRAY, country=country)),
    ]
    return _broken(*rules)


def _action_facts(action: Column, index: Column) -> Column:
    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json(action), f"$.{field}", "variant"))

    def size_of(field: str) -> Column:
        """Length of what has one: a list, a text or an object."""
        value = F.get_json_object(action, f"$.{field}")
        return (
            F.when(F.startswith(kind(field), F.lit("ARRAY")), F.json_array_length(value))
            .when(kind(field) == "STRING", F.length(value))
            .when(F.startswith(kind(field), F.lit("OBJECT")), F.size(_keys_of(value)))
        )

    number = kind("baseline_emissions_mtco2").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")

    return F.struct(
        index.alias("i"),
        _keys_of(action).alias("fields"),
        F.coalesce(F.get_json_object(action, "$.sector"), F.lit("None")).alias("sector"),
        number.alias("number"),
        F.when(number, F.get_json_object(action, "$.baseline_emissions_mtco2").try_cast("double")).alias("baseline"),
        size_of("implementation_years").alias("years"),
        size_of("yearly_improvement_pct").alias("pcts"),
    )


def _action_rules(facts: Column) -> Column:
    index = facts["i"]
    place = {"country": F.col("entry"), "action": index}
    sector = {**place, "sector": facts["sector"]}

    def has(field: str) -> Column:
        return F.array_contains(facts["fields"], field)

    targeted = has("reduction_target_pct") | has("removal_increase_pct")
    sink = facts["baseline"] < 0
    arrays = has("implementation_years") & has("yearly_improvement_pct")
    readable = F.coalesce(facts["number"], F.lit(False)) | ~has("baseline_emissions_mtco2")
    counted = facts["years"].isNotNull() & facts["pcts"].isNotNull()

    def wrong(field: str, wanted: str) -> Column:
        return said(WRONG_TYPE, **place, field=F.lit(field), wanted=F.lit(wanted))

    rules = [
        _rule(index, 9 + i, ~has(f), said(MISSING_ACTION_FIELD, **place, field=F.lit(f)))
        for i, f in enumerate(ACTION_FIELDS)
    ]
    rules += [
        _rule(index, 16, ~targeted, said(NO_ACTION_TARGET, **sector)),
        _rule(index, 17, sink & ~has("removal_increase_pct"), said(SINK_TARGET, **sector)),
        _rule(index, 18, readable & arrays & counted & (facts["years"] != facts["pcts"]), said(UNEQUAL_ARRAYS, **sector)),
        _rule(index, 19, ~readable, wrong("baseline_emissions_mtco2", "a number")),
        _rule(index, 20, arrays & facts["years"].isNull(), wrong("implementation_years", "a list")),
        _rule(index, 21, arrays & facts["pcts"].isNull(), wrong("yearly_improvement_pct", "a list")),
    ]
    return _broken(*rules)


def _checked(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows `(keys..., country_pos, entry, broken)`: one per country, or one for a document without any."""
    readable = F.when(F.expr(f"try_parse_json(`{text}`)").isNotNull(), F.col(text))
    countries = (
        docs.select(
            *keys,
            text,
            F.posexplode_outer(F.from_json(readable, "map<string,string>")).alias("country_pos", "entry", "body"),
        )
        .withColumn("_fields", _keys_of(F.col("body")))
        .withColumn("_actions", F.get_json_object("body", "$.policy_actions"))
        .withColumn(
            "_facts",
            F.transform(
                F.coalesce(F.from_json("_actions", "array<string>"), F.array().cast("array<string>")), _action_facts
            ),
        )
    )
    inside = F.concat(_country_rules(), F.flatten(F.transform("_facts", _action_rules)))
    return countries.select(
        *keys,
        F.coalesce("country_pos", F.lit(-1)).alias("country_pos"),
        "entry",
        F.when(F.col("entry").isNull(), _document_rules(text)).otherwise(inside).alias("broken"),
    )


def violations(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows `(keys..., country_pos, entry, action_idx, rule_no, message)`, one per broken rule.

    Rule 0 is the document itself: its syntax (a repeated name is wrong syntax), or not being an object. Rules 19 to 21
    are values of a type that nothing can be computed from. One pass over the documents without a shuffle.
    """
    return _checked(docs, text, keys).select(*keys, "country_pos", "entry", F.inline("broken"))


def validate(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per document: `is_valid`, the number of broken rules and the first one with its message.

    Rules are ordered by country, then the country's own rules, then its actions. The minimum is
    combined on the map side, so each document sends one row through the shuffle whatever its size.
    """
    found = _checked(docs, text, keys).select(*keys, "country_pos", F.inline_outer("broken"))
    order = F.when(F.col("rule_no").isNotNull(), F.struct("country_pos", "action_idx", "rule_no", "message"))
    return (
        found.groupBy(*keys)
        .agg(F.min(order).alias("_first"), F.count("rule_no").alias("n_violations"))
        .select(
            *keys,
            F.col("_first").isNull().alias("is_valid"),
            "n_violations",
            F.coalesce("_first.rule_no", F.lit(-1)).alias("first_rule"),
            F.coalesce("_first.message", F.lit(VALID)).alias("message"),
        )
    )


def unsorted_years(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Warning rows for actions whose implementation years are not in order."""
    years = F.col("implementation_years")
    return actions.filter(F.sort_array(years) != years).select(*keys, "action_idx", "sector", "implementation_years")
