import pytest

from plumeline.session import use_checkpoint_dir

CLASHING = ["key", "size", "bucket", "spans", "doc", "th", "component", "fold", "x", "target", "taken", "cluster", "blob", "position", "term", "cells"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with further columns whose names the operators use themselves."""
    use_checkpoint_dir(spark)

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", *["c"] * len(CLASHING)) for r in rows]
        schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented words, the same for a seed."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]

    return make
