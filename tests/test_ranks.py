import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import ranks

ROWS = 120_000
# Numbers, with ties, with a value that holds most rows, and beyond what a double tells apart.
ORDERS = {
    "different": "id * 7919 % 999983",
    "ties": "id div 30000",
    "mostly one": "if(id % 10 < 7, 5, id)",
    "large": "1152921504606846976 + id % 5000",
    "nulls": "if(id % 3 > 0, cast(id AS double), NULL)",
}


@pytest.mark.parametrize("name", list(ORDERS))
def test_folds_counted_near_their_starts_equal_those_of_all_values(spark, name, monkeypatch):
    rows = spark.range(ROWS).select("id", F.expr(ORDERS[name]).alias("v")).repartition(5, "id")
    seen = []
    whole = ranks.counted_values
    monkeypatch.setattr(ranks, "counted_values", lambda df, keys, value: seen.append(df.count()) or whole(df, keys, value))
    monkeypatch.setattr(ranks, "WHOLE", 1000)
    got = np.array(ranks.contiguous_folds(rows, "v", 5).orderBy("id").select("fold").collect())
    monkeypatch.setattr(ranks, "WHOLE", 10 * ROWS)
    want = np.array(ranks.contiguous_folds(rows, "v", 5).orderBy("id").select("fold").collect())
    assert (got == want).all()
    if name == "different":
        assert seen[0] < ROWS / 20
