import random

import pytest

from plumeline.llm import toxicity

CATEGORIES = {"rude": "rude = 1", "toxic": "toxic = 1"}


@pytest.fixture(scope="module")
def corpus(words):
    """Toxic documents are rude ones with a threat; a threat alone is harmless, so the second link needs the first."""
    r = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        w = words(r.randint(5, 120), i)
        rude, threat = r.random() < 0.3, r.random() < 0.4
        for yes, names in ((rude, ["grobbly", "grobbler", "vexnut"]), (threat, ["willhit", "willburn"])):
            if yes:
                w[r.randrange(len(w))] = r.choice(names)
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(rude), int(rude and threat)))
    return docs, labels


def test_held_out_accuracy(spark, docs_of, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    chain = toxicity.fitted(docs_of(docs), frame.where("doc_id < 1000"), CATEGORIES)
    assert [link.category for link in chain.links] == ["rude", "toxic"]
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1  # the earlier probability
    found = {r.doc_id: r for r in toxicity.scored(docs_of(docs), chain).where("doc_id >= 1000").collect()}
    rude = sum((found[i].p_rude > 0.5) == bool(y) for i, y, _ in labels[1000:])
    toxic = [(found[i].rejected, bool(y)) for i, _, y in labels[1000:]]
    assert rude / 500 > 0.97
    assert sum(a and b for a, b in toxic) / sum(b for _, b in toxic) > 0.85
    assert sum(a and not b for a, b in toxic) / sum(not b for _, b in toxic) < 0.05


def test_odd_rows(spark, docs_of, corpus, words):
    docs, labels = corpus
    frame = spark.createDataFrame([*labels[:600], (None, 1, 1), (3, None, None), (4, 1, None), (5, 0, 0), (5, 0, 0)], "doc_id long, rude int, toxic int")
    chain = toxicity.fitted(docs_of(docs), frame, CATEGORIES)
    long = " ".join(words(60_000, 5))
    odd = docs_of([(1, None), (2, ""), (3, long), (4, "vexnut grobbler willhit"), (4, "vexnut grobbler willhit"), (None, "vexnut willburn grobbly"), (7, "!!! 123 \n")])
    found = toxicity.scored(odd, chain)
    assert set(odd.columns) < set(found.columns)
    rows = found.collect()
    assert len(rows) == 7 and all(0 <= r.p_toxic <= 1 for r in rows)
    assert {r.rejected for r in rows if r.text and "vexnut" in r.text} == {True}
    assert {r.rejected for r in rows if not r.text or "vexnut" not in r.text} == {False}
    assert toxicity.scored(docs_of([]), chain).count() == 0


def test_labels_of_one_kind_or_none(spark, docs_of, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels[:50]], "doc_id long, rude int, toxic int")
    chain = toxicity.fitted(docs_of(docs), frame, CATEGORIES)
    row = toxicity.scored(docs_of(docs[:3]), chain).first()
    assert (row.p_rude, row.p_toxic, row.rejected) == (1.0, 0.0, False)
    none = toxicity.fitted(docs_of(docs), frame.limit(0), CATEGORIES)
    row = toxicity.scored(docs_of(docs[:3]), none).first()
    assert (row.p_rude, row.p_toxic, row.rejected) == (None, None, False)
    assert toxicity.fitted(docs_of([]), frame, CATEGORIES).links[0].weights == []


def test_terms_do_not_depend_on_the_batch():
    finder = toxicity.Terms()
    assert finder.of("Vexnut, vexnut!") == toxicity.Terms().of("vexnut ! , vexnut")
    assert toxicity.terms("vexnut")[0] != toxicity.terms("vexnuts")[0]
    assert set(toxicity.terms("vexnut")[1:]) & set(toxicity.terms("vexnuts")[1:])


def test_sample_is_bounded(spark, docs_of, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame(labels, "doc_id long, rude int, toxic int")
    chain = toxicity.fitted(docs_of(docs), frame, CATEGORIES, most=300)
    assert chain.links[0].weights
