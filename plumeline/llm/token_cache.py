"""Token counts by a digest cache.

The cache is a table of `(digest, n_tokens)` in a folder per tokenizer version. A text is named by the SHA-256 of its normalised content; the
tokenizer version is a digest of the vocabulary file, its library and that library's version. An update joins the digests of a delivery of
documents to the stored counts, encodes one copy of each text that has none, and appends the new counts. Counts are then joined back to all
documents by digest.

Normalised content: a null text is an empty one. Nothing else is changed, since any other change could alter a count.

Copies are reduced to one per task before the shuffle, so a text that fills a third of the table is one row per task there. A task encodes texts in
chunks, and keeps no more than a bounded number of words in mind. An update that is run again, or two that run at once, may store a digest twice;
the cache is read with one row per digest.

Results: null and empty texts have no tokens and no bytes. Repeated rows and equal texts share a stored count; every row keeps its own result. Rows without
id are counted like others. An empty table gives an empty result and leaves the cache as it is. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm.tokens import chunks, encoder, version

LIMIT = 512
CACHE = "digest string, n_tokens long"


def _content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def digest(text: str) -> Column:
    """The name of a text's normalised content."""
    return F.sha2(_content(text).cast("binary"), 256)


def folder(cache: str, tokenizer: str) -> str:
    """Where the counts of this tokenizer version lie."""
    return f"{cache.rstrip('/')}/tokenizer={version(tokenizer)}"


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The stored counts `(digest, n_tokens)` of this tokenizer version, one row per digest."""
    path = folder(cache, tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)  # so that there is a table to read
    return spark.read.schema(CACHE).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Rows `(digest, content)`: one copy of every text that `known` has no count for. One shuffle of the distinct texts serves the choice of a copy and the join."""
    named = docs.select(digest(text).alias("digest"), _content(text).alias("content"))
    return named.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")


def _encoded(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, specials=True)
        for batch in batches:
            counts = [words.counts(part) for _, part in chunks(batch.column("content"))]
            counted = pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64())
            yield pa.record_batch([batch.column("digest"), counted], names=["digest", "n_tokens"])
        words.forget()

    return run


def update(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> None:
    """Encodes what the cache at `cache` lacks and appends it. `cache` is in storage that all executors share; `tokenizer` is the vocabulary's path,
    the same on every machine."""
    new = misses(docs, stored(docs.sparkSession, cache, tokenizer), text)
    new.mapInArrow(_encoded(tokenizer), CACHE).write.mode("append").parquet(folder(cache, tokenizer))


def counted(docs: DataFrame, cache: str, tokenizer: str, doc: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows `(doc, n_bytes, n_tokens, over_limit)` of all documents; `n_tokens` is null where the cache has no count yet."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), digest(text).alias("digest"), F.octet_length(_content(text)).cast("long").alias("n_bytes"))
    known = stored(docs.sparkSession, cache, tokenizer)
    return rows.join(known, "digest", "left").select("doc", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_counts(docs: DataFrame, cache: str, tokenizer: str, doc: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Updates the cache from `docs` and returns their counts."""
    update(docs, cache, tokenizer, text)
    return counted(docs, cache, tokenizer, doc, text, limit)
