import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import shingles


def plain(text):
    w = [v for v in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if v]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def sets_of(texts):
    out = []
    for _, sets, bounds in shingles.shingle_sets(pa.array(texts, pa.string())):
        out += [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n", max_size=60)), max_size=12))
def test_sets_equal_plain_sets(texts):
    got, want = sets_of(texts), [plain(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_long_texts_and_slices(words):
    long = " ".join(words(60_000, 1))
    texts = ["a b c d e", long, None, long + " end", ""]
    got = sets_of(texts)
    assert [len(g) for g in got] == [len(plain(t)) for t in texts]
    sliced = pa.array(texts, pa.string()).slice(1, 2)
    first = next(iter(shingles.shingle_sets(sliced)))
    assert (first[1][: first[2][1]] == got[1]).all()


def test_intersections(words):
    texts = [" ".join(words(300, s // 2)[: 200 + s]) for s in range(20)]
    got, want = sets_of(texts), [plain(t) for t in texts]
    both = shingles.intersections(got, columns=64)
    assert all(both[i, j] == len(want[i] & want[j]) for i in range(20) for j in range(20))


def test_minhash_estimates_similarity(words):
    w = words(2000, 3)
    other = list(w)
    for i in range(0, 2000, 50):
        other[i] = "changed"
    (low, sets, bounds) = next(iter(shingles.shingle_sets(pa.array([" ".join(w), " ".join(other)]))))
    signed = shingles.minhash(sets, bounds, shingles.factors(512, 1))
    a, b = plain(" ".join(w)), plain(" ".join(other))
    assert abs((signed[0] == signed[1]).mean() - len(a & b) / len(a | b)) < 0.08
