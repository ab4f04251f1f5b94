"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is named by the SHA-256 of its content. The ledger holds, for each blob and rule version, the spans that the rules
found there. A scan takes the blobs of a set of versions, leaves out those that the ledger already holds under this rule version, applies
the rules to one copy of each of the others, and returns the new ledger rows; findings are joined back to every path and version with
the blob.

Places: a span is `[start, end)` in code points. Matches and the text between them come from the same expression, so places are sums of
lengths and no match is searched for again.

Results: a null text is an empty one and has no findings. Repeated rows and equal texts share one blob. Rows without path keep their findings.
An empty table gives an empty result. Other columns are carried along; those named `blob` and `spans` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.llm.graph import kept

SPAN = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, of which those stay whose `group` has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules of the contract, in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULE_VERSION = "base-1"


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans of one rule in a text, in order. The matches and the texts before them are found once, and walked through together."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        match, begin = pair["0"], state["at"] + F.length(pair["1"])
        end = begin + F.length(match)
        long_enough = F.coalesce(F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least, F.lit(False))
        span = F.array(F.struct(F.lit(rule.kind).alias("kind"), begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(long_enough, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]  # the text behind the last match comes without one, and ends the walk


def all_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of all rules, by start, then in the order of the rules."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    return F.array_sort(
        F.concat(*[spans_of(text, r) for r in rules]),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]]),
    )


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds `blob`, the SHA-256 of the text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION
) -> DataFrame:
    """New ledger rows `(blob, rule_version, spans)` for blobs of `versions` that `ledger` lacks under this rule version.

    Copies are reduced to one per task before the shuffle, so a text that fills a third of the table is one row per task."""
    blobs = addressed(versions.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)), text)
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.dropDuplicates(["blob"])
    return once.select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col(text), rules).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of `versions` with its `blob` and the ledger's `spans` for it; a blob that was never scanned has null."""
    known = ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))  # two writers may have stored a blob
    return addressed(versions.drop("spans"), text).drop(text).join(known, "blob", "left")


def update(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans `versions` against the ledger table at `path`, appends what is new, and returns the ledger. `path` is in storage that all executors share."""
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    ledger = spark.read.schema(LEDGER).parquet(path)
    scan(versions, ledger, text, rules, rule_version).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def digest(spans: Column) -> Column:
    """`kind:start:end` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with `spans`, for a table that is scanned from an empty ledger."""
    return findings(docs, kept(scan(docs, None, text)), text)
