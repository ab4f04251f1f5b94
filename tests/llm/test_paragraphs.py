import random

import pytest
from test_shingles import plain

from plumeline.llm import paragraphs


def changed(line, n, seed):
    r, w = random.Random(seed), line.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(words):
    shared = [" ".join(words(70, 900 + k)) for k in range(4)]
    out = []
    for i in range(60):
        lines = [" ".join(words(40, i * 10 + k)) for k in range(3)]
        if i % 3 == 0:
            lines.insert(1, shared[i % 4])
        if i % 5 == 0:
            lines.insert(0, changed(shared[0], 1, i))
        if i % 7 == 0:
            lines.append("short line that many documents share")
        out.append((i, "\n".join(lines)))
    out += [(100 + i, shared[3] + "\n" + " ".join(words(25, 7000 + i))) for i in range(80)]
    out += [(300, shared[1] + "\n" + shared[1]), (301, None), (302, ""), (303, "\n\n"), (304, " ".join(words(50_000, 3))), (305, " ".join(words(50_000, 3)))]
    return [*out, out[3], (None, shared[2]), (None, shared[2])]


def expected(rows, least=20):
    found = []
    for d, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            if len(line.split()) >= least:
                found.append((d, at, at + len(line), plain(line)))
            at += len(line) + 1
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda i: (found[i][0] is None, found[i][0] or 0, found[i][1])
    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][3], found[j][3]
            if len(a) <= 1.25 * len(b) and len(b) <= 1.25 * len(a) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                parent[x] = y
    groups = {}
    for i in range(len(found)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        if len(members) > 1:
            first = min(members, key=order)
            for n, i in enumerate(sorted(members, key=lambda i: (order(i), i))):
                out.append((str(found[i][0]), found[i][1], found[i][2], str(found[first][0]), found[first][1], len(members), n > 0))
    return sorted(out)


def shown(found):
    return sorted((str(r.doc), r.start, r.end, str(r.cluster_doc), r.cluster_start, r.n_paragraphs, r.removed) for r in found.collect())


def test_equals_all_pairs(docs_of, rows):
    assert shown(paragraphs.repeated(docs_of(rows))) == expected(rows)


def test_blocks_of_any_size_agree(docs_of, rows, monkeypatch):
    monkeypatch.setattr(paragraphs, "CLUSTER_BLOCK", 4)
    monkeypatch.setattr(paragraphs, "BUCKET_BLOCK", 4)
    assert shown(paragraphs.repeated(docs_of(rows))) == expected(rows)


def test_empty_table(docs_of):
    assert paragraphs.repeated(docs_of([])).count() == 0
    assert paragraphs.repeated(docs_of([(1, "one line of its own"), (2, None)])).count() == 0


def test_passages_inside_longer_lines_and_over_short_ones(docs_of, words):
    passage, junk = words(60, 1), " ".join(["a"] * 120)
    wrapped = "\n".join(" ".join(passage[i : i + 9]) for i in range(0, 60, 9))
    around = lambda k: (" ".join(words(45, 10 + k)), " ".join(words(50, 20 + k)))
    texts = {
        1: f"{around(1)[0]} é {' '.join(passage)} {around(1)[1]}",  # the first place, in the middle of a line
        2: f"{around(2)[0]} {' '.join(passage)} {around(2)[1]}",
        3: f"{wrapped}\nshort end",  # lines of 9 words
        4: f"{around(4)[0]} {' '.join(passage[:49])} {around(4)[1]}",  # one word too few
        5: junk,
        6: wrapped.replace("\n", "  \n "),
    }
    rows = [*texts.items(), (6, texts[6])]
    found = paragraphs.repeated(docs_of(rows)).collect()
    plain_passage = " ".join(passage)
    got = sorted((r.doc, " ".join(texts[r.doc][r.start : r.end].split()) == plain_passage, r.cluster_doc, r.n_paragraphs, r.removed) for r in found if r.doc != 5)
    assert got == [(1, True, 1, 5, False), (2, True, 1, 5, True), (3, True, 1, 5, True), (6, True, 1, 5, True), (6, True, 1, 5, True)]
    assert all(r.cluster_start == texts[1].index(plain_passage) for r in found if r.doc != 5)
    assert sorted((len(texts[5][r.start : r.end].split()), r.removed) for r in found if r.doc == 5) == [(50, False), (70, True)]


@pytest.mark.parametrize(("threshold", "recall", "most"), [(0.8, 0.999, 48), (0.5, 0.99, 64), (0.9, 0.9999, 128)])
def test_bands_reach_the_recall(threshold, recall, most):
    bands, rows = paragraphs.tuned(threshold, recall, most)
    assert bands * rows <= most and 1 - (1 - threshold**rows) ** bands >= recall
