from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from plumeline.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, tree string, digest string, level int, proof string, top string, n long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*[framed(v) for v in (row[0], row[1], row[2], row[3], text)])


def tree(digests):
    """The root, and for every leaf the siblings before and after, level by level."""
    sides, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
        for i, at in enumerate(place):
            run = runs[at // 8]
            sides[i].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        place, digests = [at // 8 for at in place], [h(*run) for run in runs]
    return digests[0], sides


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, own = [], {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, sides = tree([leaf(r, r[4]) for r in groups[g]])
        subroots.append(top)
        own[g] = sides
    root, above = tree(subroots)
    out = []
    for k, g in enumerate(names):
        for row, sides in zip(groups[g], own[g], strict=True):
            proof = sides + above[k]
            changed = row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            acc = leaf(row, lower(row[4]) if changed else row[4])
            for before, after in proof:
                acc = h(before, acc, after)
            out.append((row[0], leaf(row, row[4]), subroots[k], root, h(*[a + b for a, b in proof]), acc, acc == root))
    return out


@pytest.fixture(scope="module")
def made(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "c", "c", 1, "c", "c", 1) for r in rows], SCHEMA)

    return make


def found(spark, made, rows, folder):
    made(rows).write.parquet(f"{folder}/documents.parquet")
    return queries.op12_merkle_manifest(spark, str(folder))


ODD = [
    (1, "s", "en", 3, "Abc"), (2, None, "en", None, None), (3, "s", None, 0, ""), (None, "s", "en", 1, "X"), (None, "s", "en", 2, "Y"), (7, "s", "de", 1, "Ä B"), (-4, "s", "", 1, "Z"),
    (8, "s", "xx", 1, "Q"), (9, "é", "日本", 1, "lone leaf"), (2**62, "s", "en", 1, "L" * 300_000),
]


def test_equals_plain_trees(spark, made, tmp_path):
    rows = [*ODD, *[(100 + i, f"src{i % 4}", "en" if i % 5 else "fr", i, f"Text {i * i}") for i in range(700)], *[(50, "s", "en", 1, "Same")] * 90, (50, "s", "en", 1, "other")]
    got = [tuple(r) for r in found(spark, made, rows, tmp_path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_around_full_levels(spark, made, tmp_path, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)] + [(1000 + i, "s", f"l{i:03}", 1, "t") for i in range(n % 70)]
    got = [tuple(r) for r in found(spark, made, rows, tmp_path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def test_empty_table(spark, made, tmp_path):
    assert found(spark, made, [], tmp_path).collect() == []


def test_sql(spark, made, tmp_path):
    rows = [*ODD, *[(100 + i, f"src{i % 4}", "en" if i % 5 else None, i, f"Text {i}") for i in range(200)]]
    df = found(spark, made, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(df, con, queries.SQL["op12_merkle_manifest"]) == ""


def test_without_tampering_all_verify(spark, made):
    out = manifest.manifest(made([(i, "s", "en", 1, f"T{i}") for i in range(100)]))
    assert out.where(manifest.folded(F.col("told"), "proof") != F.col("root")).count() == 0


def test_order_of_rows_changes_nothing(spark, made):
    rows = [(i % 40, "s", "en", 1, f"T{i % 60}") for i in range(300)]
    roots = {manifest.manifest(made(r).repartition(n)).select("root").first()[0] for r, n in ((rows, 1), (rows[::-1], 7))}
    assert len(roots) == 1
