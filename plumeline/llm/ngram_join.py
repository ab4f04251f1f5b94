"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets decide.

1. Each text becomes the set of its five-word shingles. Equal sets are one class; the rest of the work is on classes.
2. A class has `TREES` labels of `DEPTH` MinHash values each. Labels with a common prefix are neighbours in a tree. Prefixes are
   cut to the length at which a pair just at the threshold meets in some tree with the target recall.
3. Inside a prefix group whole signatures are compared, and only links that join the group's similar rows are kept. Their
   components are the clusters; in a cluster every pair is verified with the exact sets, two blocks of rows at a time.

Results (documents): a null or empty text has no shingles and links with nothing. Repeated rows are copies of each other. A text of one to
four words is one shingle. A row without id counts as a copy like any other; names are the smallest ids that are there,
and null where a class has none. An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm import shingles
from plumeline.llm.graph import block_pairs, components, forest, kept, runs, together

THRESHOLD = 0.8
TREES, DEPTH = 16, 8
TARGET_RECALL = 0.9995
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 192
VALUES = TREES * DEPTH


def signatures(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """Rows `(doc, th, key, n, sig)`: hash of the text, key of the shingle set (null without words), its size, and the MinHash values."""
    factors = shingles.factors(VALUES, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets, bounds in shingles.shingle_sets(batch.column(2)):
                values = shingles.minhash(sets, bounds, factors)
                sizes = np.diff(bounds)
                keys = [
                    blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                part = batch.slice(low, len(sizes))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())]
                    + [pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["doc", "th", "key", "n", "sig"],
                )

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, th long, key binary, n int, sig binary")


def classes(signed: DataFrame) -> DataFrame:
    """One row for each different shingle set: smallest document, number of copies, and one text's hash to fetch it by."""
    return signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "th")).alias("least"),
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"),
    ).select("key", F.col("least.doc").alias("doc"), F.col("least.th").alias("th"), "copies", "n", "sig")


def prefix_groups(sets: DataFrame, length: int) -> DataFrame:
    """Rows `(key, bucket, size)`: the classes whose labels share a prefix of `length` values in some tree.

    Trees whose groups hold the same classes are told by two checksums, and one of them is enough."""
    tries = [F.xxhash64(F.lit(t), F.substring("sig", t * DEPTH * 2 + 1, length * 2)) for t in range(TREES)]
    labels = sets.select("key", F.explode(F.array(*tries)).alias("bucket"))
    mark = F.xxhash64("key")
    groups = labels.groupBy("bucket").agg(
        F.count("*").alias("size"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y")
    ).where("size > 1")
    once = groups.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return labels.join(once, "bucket")


def _candidate_links(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in runs(batches, ["bucket", "low", "high"]):
            if table.num_rows < 2:
                continue
            keys = table.column("key").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, VALUES)

            def similar(i: int, others: np.ndarray, sig=sig) -> np.ndarray:
                return (sig[others] == sig[i]).mean(axis=1) >= cut

            for i, j in forest(similar, len(keys)):
                a.append(keys[i])
                b.append(keys[j])
            if len(a) >= 4096:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    return run


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def prefix_length(threshold: float, target: float) -> int:
    """The longest prefix at which a pair exactly at the threshold meets in some tree with probability `target`."""
    return next((n for n in range(DEPTH, 0, -1) if 1 - (1 - threshold**n) ** TREES >= target), 1)


def candidates(sets: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Links `(a, b)` whose components hold every candidate pair. A pair of similarity s meets at length d with probability
    1 - (1 - s^d)^TREES; prefixes are as short as a pair at the threshold needs, whatever else is in the table."""
    cut = threshold - 4 * (threshold * (1 - threshold) / VALUES) ** 0.5
    members = prefix_groups(sets, prefix_length(threshold, target)).join(sets.select("key", "sig"), "key")
    dealt = block_pairs(members, "bucket", "size", "key", BUCKET_BLOCK).where("n_blocks = 1 or low < high")
    ordered = together(dealt.select("bucket", "low", "high", "key", "sig"), ["bucket", "low", "high"])
    return kept(ordered.mapInArrow(_candidate_links(cut), "a binary, b binary"))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "low", "high"]):
            keys, texts = table.column("key").to_pylist(), table.column("text").combine_chunks()
            sets, first = [], {}
            for start, values, bounds in shingles.shingle_sets(texts):
                for i in range(len(bounds) - 1):
                    own = values[bounds[i] : bounds[i + 1]]
                    if keys[start + i] not in first and blake2b(own.tobytes(), digest_size=16).digest() == keys[start + i]:
                        first[keys[start + i]] = start + i
                        sets.append(own)
            if len(sets) < 2:
                continue
            rows = table.take(pa.array(list(first.values())))
            block, copies, keys = rows.column("block").to_numpy(), rows.column("copies").to_numpy(), list(first)
            sizes = np.array([len(s) for s in sets])
            both = shingles.intersections(sets)
            linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            tree = forest(lambda i, others, linked=linked: linked[i, others], len(sets))
            if table.column("low")[0].as_py() != table.column("high")[0].as_py():
                linked &= block[:, None] != block[None, :]
            counts = (linked * copies[None, :]).sum(axis=1)
            has = np.flatnonzero(counts)
            yield _found([keys[i] for i in has] + [keys[i] for i, _ in tree], [None] * len(has) + [keys[j] for _, j in tree],
                         [int(counts[i]) for i in has] + [0] * len(tree))

    return run


def _found(key: list, other: list, links: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key, pa.binary()), pa.array(other, pa.binary()), pa.array(links, pa.int64())], names=["key", "other", "links"])


def verified(docs: DataFrame, text: str, doc: str, sets: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Rows `(key, other, links)`: how many documents of other classes a class links with in a pair of blocks (other null), and links
    that join linked classes. One text of each class is fetched by id and hash; the set's key is checked again."""
    size = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = clusters.join(size, "component").join(sets.select("key", "doc", "th", "copies"), F.col("node") == F.col("key"))
    members = members.select("key", "component", "size", "copies", F.col("doc").alias("_doc"), F.col("th").alias("_th"))
    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    texts = texts.join(members, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    dealt = block_pairs(texts, "component", "size", "key", CLUSTER_BLOCK)
    ordered = together(
        dealt.select(F.xxhash64("component").alias("cluster"), "low", "high", "key", "block", "copies", "text"),
        ["cluster", "low", "high"], "key",
    )
    return ordered.mapInArrow(_verified(threshold), "key binary, other binary, links long")


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: `doc`, `th` (hash of its text), `key`, `class_id`, `n_copies` of its class, `n_links` (other documents with a
    Jaccard similarity of `threshold` or more, copies counted), `group_id` (smallest id that links lead to), and `stays`: true for the
    one `(doc, th)` of each group that is kept, and for every document without words."""
    signed = kept(signatures(docs, text, doc))
    sets = kept(classes(signed))
    links = candidates(sets, threshold)
    clusters = kept(components(links))
    found = kept(verified(docs, text, doc, sets, clusters, threshold))
    counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = sets.join(groups.select(F.col("node").alias("key"), "component"), "key", "left").join(counts, "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "th")).alias("least"))
    named = named.join(least, "component").select(
        "key", F.col("doc").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("links"), "least"
    )
    rows = signed.select("doc", "th", "key").join(named, "key", "left")
    first = F.col("doc").eqNullSafe(F.col("least.doc")) & (F.col("th") == F.col("least.th"))
    alone = F.col("key").isNull()
    return rows.select(
        "doc", "th", "key",
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("n_copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("doc")).otherwise(F.col("least.doc")).alias("group_id"),
        (alone | first).alias("stays"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group of near duplicates left: the one with the smallest id. Documents without words stay."""
    found = near_duplicates(docs, text, doc, threshold)
    # No key is null, so the join and the choice of one of equal rows share one shuffle of the texts.
    staying = found.where("key is not null and stays").select(F.col("th").alias("_th"), F.coalesce("doc", F.lit(0)).alias("_id"), F.col("doc").isNull().alias("_none"))
    ident = F.col(doc).cast("long")
    rows = docs.select(
        F.xxhash64(text).alias("_th"), F.coalesce(ident, F.lit(0)).alias("_id"), ident.isNull().alias("_none"), *[F.col(c).alias(f"_in_{c}") for c in docs.columns]
    )
    worded = F.coalesce(F.col(f"_in_{text}").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = rows.where(worded).join(staying, ["_th", "_id", "_none"], "left_semi").dropDuplicates(["_th", "_id", "_none"])
    out = first.unionByName(rows.where(~worded))
    return out.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
