"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model over the presence of terms; a later model also gets the earlier categories'
probabilities. For its training those are out-of-fold predictions, made by models that did not see the row. Terms are words, their beginnings
and runs of signs, hashed; those that tell a category apart most clearly over the training rows are the features.

The models are fitted on at most about MOST_TRAINING labelled documents, chosen by hash; all documents are scored, whole.

Results: a null or empty text has no terms and gets the models' base rates. Documents with a null label are not trained on; several labels of one id count as
the highest. Without labels of both kinds a category's probability is the share of its positives, or null if there are no labels at all; null never
rejects. Repeated rows and rows without id are scored like others. Other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.graph import kept

MOST_TRAINING = 40_000
SPACE = 1 << 20  # hashed terms
FEATURES = 128  # for each category
LEAST_DOCS = 4
CLEAR = 4.0  # standard deviations by which a feature's count must differ from chance
FOLDS = 3
CHUNK = 1024  # documents whose feature rows are in memory at a time
STEMS = range(3, 8)
MOST_WORDS = 100_000  # words whose terms a worker remembers
_term = re.compile(r"[^\W\d_]+|[^\w\s]+")


def terms(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    names = [word, *["^" + word[:k] for k in STEMS if len(word) >= k]] if word[0].isalpha() else [word[:3]]
    return [crc32(n.encode()) % SPACE for n in names]


class Terms:
    """Numbers of the terms of texts; a worker remembers words it has met."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.known = chosen, {}

    def of(self, text: str | None) -> set[int]:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        out: set[int] = set()
        for word in set(_term.findall((text or "").lower())):
            own = self.known.get(word)
            if own is None:
                own = tuple(terms(word))
                if self.chosen is not None:
                    own = tuple([self.chosen[h] for h in own if h in self.chosen])
                self.known[word] = own
            if own:
                out.update(own)
        return out


@dataclass
class Link:
    """One model of the chain: weights of the terms, then of the earlier categories' probabilities."""

    category: str
    weights: list[float] = field(default_factory=list)
    offset: float = 0.0
    share: float | None = None  # set where only one kind of label exists: the probability of every document


@dataclass
class Chain:
    features: dict[int, int]
    links: list[Link]
    threshold: float  # for the last category

    def probabilities(self, found: list[set[int]]) -> np.ndarray:
        """One row per document, one column per category; NaN where nothing is known."""
        x = np.zeros((len(found), len(self.features)))
        for i, own in enumerate(found):
            x[i, list(own)] = 1.0
        for link in self.links:
            if link.weights:
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(link.weights) + link.offset, -500, 500)))
            else:
                p = np.full(len(x), np.nan if link.share is None else link.share)
            x = np.hstack([x, p[:, None]])
        return x[:, len(self.features) :]


def _counts(n_categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n = Terms(), np.zeros((SPACE, n_categories + 1), dtype=np.int32)
        for batch in batches:
            labels = np.stack([batch.column(1 + j).to_numpy() for j in range(n_categories)], axis=1)
            for row, own in enumerate(labels):
                at = np.fromiter(finder.of(batch.column(0)[row].as_py()), dtype=np.int64)
                n[at, 0] += 1
                for j in np.flatnonzero(own):
                    n[at, 1 + j] += 1
        has = np.flatnonzero(n[:, 0])
        for low in range(0, len(has), 50_000):
            rows = has[low : low + 50_000]
            columns = [pa.array(rows), *[pa.array(n[rows, j].astype(np.int64)) for j in range(n_categories + 1)]]
            yield pa.record_batch(columns, names=["term", "n", *[f"n_{j}" for j in range(n_categories)]])

    return run


def _rows(chosen: dict[int, int], n_categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Terms(chosen)
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                x = np.zeros((part.num_rows, len(chosen)))
                for i, text in enumerate(part.column(0).to_pylist()):
                    x[i, list(finder.of(text))] = 1.0
                yield pa.record_batch(
                    [pa.array(list(x), pa.list_(pa.float64())), *part.columns[1:]],
                    names=["x", *[f"y_{j}" for j in range(n_categories)], "fold"],
                )

    return run


def fitted(docs: DataFrame, labels: DataFrame, categories: dict[str, str], text: str = "text", doc: str = "doc_id", most: int = MOST_TRAINING) -> Chain:
    """Fits the chain. `categories` names them in order, each with an SQL condition on the columns of `labels`."""
    names, m = list(categories), len(categories)
    marks = [F.expr(condition).cast("int").alias(f"y_{j}") for j, condition in enumerate(categories.values())]
    known = labels.select(F.col(doc).alias("_id"), *marks).dropna().groupBy("_id").agg(*[F.max(f"y_{j}").alias(f"y_{j}") for j in range(m)])
    known = kept(known)
    share = min(1.0, most / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about `most` rows, however many there are
    texts = docs.select(F.col(doc).alias("_id"), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "_id").withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int"))

    counted = joined.select("text", *[f"y_{j}" for j in range(m)]).mapInArrow(_counts(m), "term long, n long" + "".join(f", n_{j} long" for j in range(m)))
    counted = kept(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ["n", *[f"n_{j}" for j in range(m)]]]).where(F.col("n") >= LEAST_DOCS))
    totals = joined.agg(F.count("*").alias("n"), *[F.sum(f"y_{j}").alias(f"n_{j}") for j in range(m)]).first()
    chosen: dict[int, int] = {}
    for j in range(m):
        rate = (totals[f"n_{j}"] or 0) / max(1, totals["n"])
        expected = F.col("n") * rate
        clear = F.abs(F.col(f"n_{j}") - expected) / F.sqrt(expected * (1 - rate) + 1)
        for row in counted.where(clear >= CLEAR).orderBy(F.desc(clear), "term").limit(FEATURES).select("term").collect():
            chosen.setdefault(row[0], len(chosen))
    if not chosen:
        return Chain({}, [Link(c, share=(totals[f"n_{j}"] / totals["n"] if totals["n"] else None)) for j, c in enumerate(names)], 0.5)

    schema = "x array<double>" + "".join(f", y_{j} int" for j in range(m)) + ", fold int"
    rows = kept(joined.select("text", *[f"y_{j}" for j in range(m)], "fold").mapInArrow(_rows(chosen, m), schema))
    links, threshold = [], 0.5
    for j, name in enumerate(names):
        kinds = rows.agg(F.min(f"y_{j}"), F.max(f"y_{j}"), F.avg(f"y_{j}")).first()
        if kinds[0] == kinds[1]:
            links.append(Link(name, share=float(kinds[2])))
            rows = rows.withColumn("x", F.concat("x", F.array(F.lit(float(kinds[2])))))
            continue
        own = rows.select("fold", F.col(f"y_{j}").cast("double").alias("label"), array_to_vector("x").alias("features"), *[c for c in rows.columns if c != "fold"])
        learner = LogisticRegression(regParam=1e-4, maxIter=40)
        out = None
        for k in range(FOLDS):
            model = learner.fit(own.where(F.col("fold") != k))
            scored = model.transform(own.where(F.col("fold") == k))
            scored = scored.withColumn("p", F.get(vector_to_array("probability"), 1))
            out = scored if out is None else out.unionByName(scored)
        model = learner.fit(own)
        links.append(Link(name, [float(w) for w in model.coefficients.toArray()], float(model.intercept)))
        out = kept(out.select("x", *[f"y_{i}" for i in range(m)], "fold", "p"))
        if j == m - 1:
            threshold = _best_threshold(out.select(F.round("p", 2).alias("p"), f"y_{j}"), f"y_{j}")
        rows = out.withColumn("x", F.concat("x", F.array("p"))).drop("p")
    return Chain(chosen, links, threshold)


def _best_threshold(scored: DataFrame, label: str) -> float:
    """The threshold of the best F1 on out-of-fold predictions, in hundredths (at most 101 rows come to the driver)."""
    counts = scored.groupBy("p").agg(F.sum(label).alias("hits"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()
    wanted, hits, n, best = sum(r["hits"] for r in counts), 0, 0, (0.0, 0.5)
    for i, r in enumerate(counts):
        hits, n = hits + r["hits"], n + r["n"]
        after = counts[i + 1]["p"] if i + 1 < len(counts) else 0.0
        best = max(best, (2 * hits / (n + wanted), (r["p"] + after) / 2))
    return best[1]


def scored(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds `p_<category>` for each category and `rejected`: whether the last one's probability is above the threshold."""

    names = [f"p_{link.category}" for link in chain.links]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Terms(chain.features)
        for texts in parts:
            found = [chain.probabilities([finder.of(t) for t in texts[low : low + CHUNK]]) for low in range(0, len(texts), CHUNK)]
            yield pd.DataFrame(np.concatenate(found) if found else np.zeros((0, len(names))), columns=names)

    out = docs.withColumn("_toxicity", run(F.col(text).cast("string")))
    out = out.withColumns({n: F.nanvl(F.col(f"_toxicity.{n}"), F.lit(None).cast("double")) for n in names}).drop("_toxicity")
    return out.withColumn("rejected", F.coalesce(F.col(names[-1]) > chain.threshold, F.lit(False)))
