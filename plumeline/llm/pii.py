"""Personal data: patterns, and terms that give a protected entity away.

Patterns find mail addresses, network addresses, card and phone numbers; each value that occurs is a protected entity. Words that stand near an entity
are counted together with it over all documents: a term t reveals an entity c by their pointwise mutual information, as a share of the information in
c itself, PMI(c, t) / -log2 p(c). A term that reveals more than the disclosure threshold, and was seen with it in enough different surroundings to tell, is
sanitised wherever it stands near that entity: it becomes a span of kind `term` and is replaced by a general word, as the patterns' values are.

Results: a null text is an empty one. Repeated rows are sanitised each; equal texts count as one document. Rows without id are sanitised like others. Very long runs of one character
class are read once. Spans are `[start, end)` in code points; a term that overlaps a pattern's span adds none. An empty table gives an empty result.
Other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumeline.llm.graph import kept

NEAR = 6  # words on either side of an entity
LEAST_CONTEXTS = 5  # different surroundings in which a term stands near an entity before anything is concluded
MOST_BROADCAST = 500_000  # pairs of an entity and a term that are sent to every task at once
SPANS = "array<struct<kind:string,start:int,end:int>>"
DISCLOSURE = 0.7  # share of an entity's information that a term may reveal

# The kinds in the order in which spans of equal start are listed, and what replaces them.
KINDS = ("email", "ip", "card", "phone")
GENERAL = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>", "term": "<term>"}

# The patterns of the contract. A lookbehind keeps a long run from being tried again at every place in it.
_local = re.compile(r"[A-Za-z0-9._%+-]+")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{3,}")
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _not_local.match(text, start - 1):
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = at + 1  # no address begins before this sign and goes beyond it
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds, by start, then in the order of KINDS."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _phone.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """Spellings of one value are one entity."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


def near_terms(text: str, start: int, end: int, reach: int = NEAR) -> list[tuple[int, int]]:
    """Places of the words around a span."""
    width = reach * 40
    before = [m.span() for m in _word.finditer(text, max(0, start - width), start)][-reach:]
    after = []
    for m in _word.finditer(text, end, end + width):
        after.append(m.span())
        if len(after) == reach:
            break
    return before + after


def contexts(text: str) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Each entity of a text with a mark of its surroundings and the places of the terms in them."""
    for kind, a, b in base_spans(text):
        places = near_terms(text, a, b)
        around = " ".join(text[x:y] for x, y in places).lower()
        yield entity(kind, text[a:b]), crc32(around.encode()), places


def _cooccurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = set()
        for text in batch.column(0).to_pylist():
            for name, mark, places in contexts(text):
                rows.add((name, mark, None))
                rows.update((name, mark, text[x:y].lower()) for x, y in places)
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entity", "mark", "term"])


def disclosures(docs: DataFrame, text: str = "text", least: int = LEAST_CONTEXTS, threshold: float = DISCLOSURE) -> DataFrame:
    """Rows `(entity, term, share)`: terms that reveal an entity beyond the threshold.

    Equal surroundings of an entity count once, and equal texts are one document, so copies prove nothing and hide nothing. Pairs, and the documents that hold a term, are counted with partial sums in the
    tasks, so no word's rows are gathered; pairs below `least` go before the counts are joined."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    seen = texts.select("text").mapInArrow(_cooccurring, "entity string, mark long, term string").distinct()
    counted = kept(seen.groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    pairs = counted.where("term is not null").withColumnRenamed("n", "both")
    term_docs = _texts_with(texts).join(pairs.select("term").distinct(), "term", "left_semi")
    n = F.lit(float(texts.select("th").distinct().count()))
    entities = counted.where("term is null").select("entity", F.col("n").alias("n_entity"))
    joined = pairs.join(entities, "entity").join(term_docs, "term")
    revealed = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
    own = F.log2(n / F.col("n_entity"))
    share = F.when(own > 0, revealed / own)
    return joined.withColumn("share", share).where(F.col("share") > threshold).select("entity", "term", "share")


def _texts_with(texts: DataFrame) -> DataFrame:
    """Rows `(term, n_term)`: in how many different texts `(th, text)` a word stands.

    All rows are counted with partial sums in the tasks, and what copies add is taken away again; for that only one of each text that has copies is shuffled. Up to
    MOST_BROADCAST hashes of such texts are sent to the tasks; more of them are joined by a shuffle."""
    terms = F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))).alias("term")
    every = texts.select(terms).groupBy("term").agg(F.count("*").alias("_all"))
    copied = kept(texts.groupBy("th").agg((F.count("*") - 1).alias("_more")).where("_more > 0"))
    copied = F.broadcast(copied) if copied.count() <= MOST_BROADCAST else copied
    once = texts.join(copied, "th").dropDuplicates(["th"])
    more = once.select("_more", terms).groupBy("term").agg(F.sum("_more").alias("_more"))
    return every.join(more, "term", "left").select("term", (F.col("_all") - F.coalesce("_more", F.lit(0))).alias("n_term"))


def _spans(text: str, revealed: set[tuple[str, str]]) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    if not base or not revealed:
        return base
    terms = {
        (x, y) for name, _, places in contexts(text) for x, y in places
        if (name, text[x:y].lower()) in revealed and not any(a < y and x < b for _, a, b in base)
    }
    return merged(base, [("term", x, y) for x, y in terms])


def merged(*spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All different spans, by start, then by kind in the order listed."""
    order = (*KINDS, "term")
    return sorted(set().union(*map(tuple, spans)), key=lambda s: (s[1], order.index(s[0]), s[2]))


def generalised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind's general word; spans that overlap are replaced together."""
    out, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], GENERAL[kind]]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def _spans_of(revealed: set[tuple[str, str]]):
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        found = [_spans(t, revealed) if t else [] for t in texts]
        return pd.Series([[{"kind": kind, "start": a, "end": b} for kind, a, b in spans] for spans in found])

    return run


def _text_of(revealed: set[tuple[str, str]]):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([generalised(t, _spans(t, revealed)) if t else t for t in texts])

    return run


def _text_of_spans():
    @F.pandas_udf(StringType())
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        listed = [[(x["kind"], x["start"], x["end"]) for x in s] for s in spans]
        return pd.Series([generalised(t, own) if t else t for t, own in zip(texts, listed, strict=True)])

    return run


def _slices(docs: DataFrame, text: str, least: int, threshold: float) -> Iterator[tuple[set[tuple[str, str]], int]]:
    """The disclosing pairs in sets of at most about MOST_BROADCAST, each with their number."""
    pairs = kept(disclosures(docs, text, least, threshold))
    n = max(1, -(-pairs.count() // MOST_BROADCAST))
    for k in range(n):
        own = pairs.where(F.pmod(F.xxhash64("entity", "term"), F.lit(n)) == k).select("entity", "term").toArrow()
        yield set(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)), n


def found(docs: DataFrame, text: str = "text", least: int = LEAST_CONTEXTS, threshold: float = DISCLOSURE) -> DataFrame:
    """Adds `spans` (kind, start, end) to every row, in place of a column of that name: the patterns' and those of disclosing terms.

    The disclosing pairs go to the tasks in slices of at most about MOST_BROADCAST, one pass per slice, so what is sent is bounded
    and none is left out."""
    order = F.create_map(*[x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))])
    out, parts = docs, []
    for k, (revealed, _) in enumerate(_slices(docs, text, least, threshold)):
        parts.append(f"_spans_{k}")
        out = out.withColumn(parts[-1], _spans_of(revealed)(F.col(text).cast("string")))
    if len(parts) == 1:
        return out.withColumn("spans", F.col(parts[0])).drop(*parts)
    spans = F.array_sort(
        F.array_distinct(F.concat(*parts)),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["kind"] != b["kind"], order[a["kind"]] - order[b["kind"]]).otherwise(a["end"] - b["end"]),
    )
    return out.withColumn("spans", spans).drop(*parts)


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their texts sanitised; null texts stay null."""
    first = next(slices := _slices(docs, text, LEAST_CONTEXTS, DISCLOSURE))
    if first[1] == 1:  # the usual case: texts pass through Python once
        return docs.withColumn(text, _text_of(first[0])(F.col(text).cast("string")))
    slices.close()
    named = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    out = found(named, f"_in_{text}")
    out = out.withColumn(f"_in_{text}", _text_of_spans()(F.col(f"_in_{text}").cast("string"), "spans"))
    return out.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """`kind:start:end` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
