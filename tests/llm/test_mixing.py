import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumeline.llm import mixing, queries


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by raising the level until the words are given out."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high, total = 0.0, 1e9, share * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * sizes[s], level * weight[s]) for s in names) < total else (low, level)
    return {s: min(most * sizes[s], low * weight[s]) for s in names}


@pytest.fixture(scope="module")
def rows(words):
    r = random.Random(4)
    out = [(i, " ".join(words(r.randint(1, 60), i)), r.choice(["a", "b", "c", "d", "hot", "hot", "hot", None])) for i in range(900)]
    out += [(2000, None, "a"), (2001, "", "b"), (2002, " \t\n ", "c"), (2003, "only", "é"), (2004, " ".join(words(30_000, 7)), "d"), (None, "no id here", "a")]
    return out + [out[5], out[5], (3000, "", "empty source")]


def test_contract(docs_of, rows):
    found = mixing.assigned(docs_of(rows)).select("doc_id", "source", "size", "source_size", "target", "taken", "_mx_copies").collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    want = water(sizes)
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(d), count(t)) for d, t, _ in rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-4)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r._mx_copies)
        assert all(0 <= c.position <= 1 for c in r._mx_copies)
        assert [c.position for c in r._mx_copies] == sorted(c.position for c in r._mx_copies)
    for source in sizes:
        assert sum(r.taken for r in found if r.source == source) == pytest.approx(want[source], abs=1)


def test_reruns_and_partitions_agree(docs_of, rows, monkeypatch):
    def run(docs):
        return sorted((str(r.doc_id), r.size, r.taken) for r in mixing.assigned(docs).collect())

    once = run(docs_of(rows))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    assert run(docs_of(rows[::-1]).repartition(7)) == once


def test_time_inverts_the_integral(spark):
    schedule = ((0.0, 3.0), (0.25, 1.0), (0.5, 1.0), (1.0, 0.0))

    def integral(t):
        total = 0.0
        for (a, x), (b, y) in zip(schedule[:-1], schedule[1:], strict=True):
            d = min(max(t - a, 0.0), b - a)
            total += x * d + (y - x) / (b - a) * d * d / 2
        return total

    fractions = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(f,) for f in fractions], "f double").select(mixing.time_of(F.col("f"), schedule)).collect()
    for f, (t,) in zip(fractions, got, strict=True):
        assert integral(t) == pytest.approx(f * integral(1.0), abs=1e-9)


def test_schedules_order_the_sources(docs_of, words):
    docs = docs_of([(i, " ".join(words(10, i)), "abc"[i % 3]) for i in range(600)])
    means = {r.source: r.m for r in mixing.assigned(docs).groupBy("source").agg(F.avg(F.get("_mx_copies", 0)["position"]).alias("m")).collect()}
    assert means["a"] < means["b"] < means["c"] or means["a"] < means["c"]  # the broad source comes first


def test_training_order(docs_of, rows):
    docs = docs_of(rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = sorted((str(r.doc_id), r.taken) for r in mixing.assigned(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect() if r.taken)
    words_out = {}
    texts = {d: t for d, t, _ in rows}
    for r in out.collect():
        words_out[str(r.doc_id)] = words_out.get(str(r.doc_id), 0) + count(r.text)
        assert texts[r.doc_id].startswith(r.text)
    assert sorted(words_out.items()) == taken


def test_empty_table(docs_of):
    assert mixing.assigned(docs_of([])).count() == 0 and mixing.mixed(docs_of([])).count() == 0


def test_only_empty_texts(docs_of):
    found = mixing.assigned(docs_of([(1, "", "a"), (2, None, None)])).collect()
    assert {(r.size, r.taken, r.target) for r in found} == {(0, 0, 0.0)} and not math.isnan(found[0].target)


def test_query_runs_in_training_order(spark, docs_of, rows, tmp_path):
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_source_mix(spark, str(tmp_path)).collect()  # the parts of a range sort in their order
    first = [2.0 if r.position is None else r.position for r in found]
    assert first == sorted(first) and len(found) == len(rows) and len(set(first)) > 500
