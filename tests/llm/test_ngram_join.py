import random

import numpy as np
import pytest
from test_shingles import plain

from plumeline.llm import graph, ngram_join


def near(words, base, changes, seed):
    r, w = random.Random(seed), list(base)
    for _ in range(changes):
        w[r.randrange(len(w))] = f"other{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(words):
    base = [words(180, s) for s in range(6)]
    out = []
    for k, b in enumerate(base):
        out += [near(words, b, c, 100 * k + c) for c in range(7)]
    out += [" ".join(base[0])] * 40  # copies
    out += [near(words, base[1], 2, 7000 + i) for i in range(60)]  # a large group of near copies
    out += ["one two three", "one two three", "one two", "", None, None, "   ", " ".join(words(40_000, 99)), " ".join(words(40_000, 99)) + " end"]
    return list(enumerate(out)) + [(3, out[3]), (None, " ".join(base[2])), (None, " ".join(base[2]))]


def expected(rows):
    sets = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[x] = y
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return sorted((str(rows[i][0]), links[i], str(least[root(i)])) for i in range(len(rows)))


def test_equals_all_pairs(docs_of, rows):
    found = ngram_join.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc), r.n_links, str(r.group_id)) for r in found) == expected(rows)


def test_one_of_each_group_stays(docs_of, rows):
    docs = docs_of(rows)
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    got = sorted(str(r.doc_id) for r in left.collect())
    empty = [str(d) for d, t in rows if not plain(t)]
    worded = {g for (d, _, g), in zip(expected([r for r in rows if plain(r[1])]))}
    assert got == sorted(list(worded) + empty)


def test_blocks_of_any_size_agree(docs_of, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    found = ngram_join.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc), r.n_links, str(r.group_id)) for r in found) == expected(rows)


def border(words, k):
    """Two texts of 185 words with 4 changes: a similarity of 161 / 201."""
    a = words(185, 50_000 + k)
    return " ".join(a), " ".join(f"x{k}" if i in (20, 60, 100, 140) else w for i, w in enumerate(a))


def test_pairs_at_the_threshold_beside_a_tight_group(docs_of, words):
    base = words(180, 3)
    pairs = [t for k in range(1200) for t in border(words, k)]
    tight = [near(words, base, 1, 9000 + i) for i in range(300)]
    found = ngram_join.near_duplicates(docs_of(list(enumerate(pairs + tight)))).where("doc < 2400 and n_links > 0").count()
    assert found >= 2 * 1199


def test_empty_table(docs_of):
    assert ngram_join.near_duplicates(docs_of([])).count() == 0
    assert ngram_join.keep_one(docs_of([])).count() == 0


def test_components(spark, docs_of):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {c.node: c.component for c in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    close = np.triu(rng.random((50, 50)) < 0.03, 1)
    close |= close.T
    links = graph.forest(lambda i, others: close[i, others], 50)

    def groups(pairs):
        label = list(range(50))
        for _ in range(50):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(links) == groups(np.argwhere(close).tolist())
