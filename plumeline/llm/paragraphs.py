"""Substring dedup: paragraphs that repeat, found by MinHash banding.

A document is split at line ends; a paragraph is a line with enough words. Paragraphs with equal sets of five-word shingles are one class. The numbers of
bands and of values in a band are tuned so that a pair at the threshold meets in some band with the wanted recall. Classes that collide in
a band and have similar signatures are linked; in the components of these links every pair is verified by the exact Jaccard similarity. The components of the
verified links, and classes with several paragraphs, are the clusters; one paragraph of each is kept and the others are removals.

What the removed lines leave is searched for passages: runs of `PASSAGE` or more equal words, wherever they begin in a line and however they are wrapped. Winnowing picks
runs of `GRAM` words so that every passage holds a picked one; around the picked runs that stand in several places all windows of `PASSAGE` words are counted. The
first place of a window is kept, the others are removals; windows that overlap in a document are one span.

Results: a null or empty text has no paragraphs, and paragraphs with too few words never appear. Repeated rows and repeated paragraphs of one document are copies; the first
place (smallest document, then smallest start) is kept, and of several rows tied there, one. Rows without id come last. Very long lines are paragraphs as
others. Passages compare words, not the white space between them, and do not reach over a removed line; repeats that overlap their first place stay. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm import shingles
from plumeline.llm.graph import block_pairs, components, forest, freed, kept, runs, together

THRESHOLD = 0.8
RECALL = 0.999
MOST_VALUES = 48
LEAST_WORDS = 20
PASSAGE, GRAM = 50, 25  # words of the shortest passage, and of the runs that are picked from it
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 512


def tuned(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and values per band: the longest bands that reach the recall at the threshold with at most so many values, and as many as that takes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (int(bands), rows)
    return best


def lines_of(text: str | None, least: int) -> list[tuple[int, int]]:
    """Places of the lines that may be long enough to be paragraphs."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        if len(line) >= 2 * least - 1:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _cut(texts: list[str | None], least: int) -> tuple[list[int], list[tuple[int, int]], list[str]]:
    owner, places, lines = [], [], []
    for i, text in enumerate(texts):
        for a, b in lines_of(text, least):
            owner.append(i)
            places.append((a, b))
            lines.append(text[a:b])
    return owner, places, lines


def key_of(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def _paragraphs(least: int, values: int):
    """Rows `(doc, th, start, end, key)`, th the hash of the text, and, where `values` is not 0, the MinHash signature."""
    factors = shingles.factors(values, 29)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = batch.slice(low, 512)
                owner, places, lines = _cut(rows.column(2).to_pylist(), least)
                keep, keys, sigs = [], [], []
                for start, sets, bounds in shingles.shingle_sets(pa.array(lines, pa.string())):
                    words = [len(line.split()) for line in lines[start : start + len(bounds) - 1]]
                    signed = shingles.minhash(sets, bounds, factors)
                    for i, n in enumerate(words):
                        if n >= least and bounds[i + 1] > bounds[i]:
                            keep.append(start + i)
                            keys.append(key_of(sets[bounds[i] : bounds[i + 1]]))
                            sigs.append(signed[i].tobytes())
                own = rows.select(["doc", "th"]).take(pa.array([owner[k] for k in keep], pa.int64()))
                columns = [*own.columns, pa.array([places[k][0] for k in keep], pa.int32()), pa.array([places[k][1] for k in keep], pa.int32())]
                columns += [pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())][: 2 if values else 1]
                yield pa.record_batch(columns, names=["doc", "th", "start", "end", "key", "sig"][: len(columns)])

    return run


def _texts(docs: DataFrame, text: str, doc: str) -> DataFrame:
    return docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))


def _similar(values: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in runs(batches, ["bucket", "low", "high"]):
            if table.num_rows < 2:
                continue
            keys = table.column("key").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, values)
            for i, j in forest(lambda i, others, sig=sig: (sig[others] == sig[i]).mean(axis=1) >= cut, len(keys)):
                a.append(keys[i])
                b.append(keys[j])
            if len(a) >= 4096:
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def colliding(sets: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The classes that share a band with another one, and links `(a, b)` between those with similar signatures; their components hold every such pair.

    Bands are dealt out with a 64-bit mark in place of the key; a pair of marks that agree by chance adds a candidate and takes none away."""
    values = bands * rows
    labels = [F.xxhash64(F.lit(k), F.substring("sig", k * rows * 2 + 1, rows * 2)) for k in range(bands)]
    dealt = sets.select(F.xxhash64("key").alias("mark"), F.explode(F.array(*labels)).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    dealt = kept(dealt.join(shared, "bucket"))
    hits = sets.join(dealt.select("mark").distinct(), F.xxhash64("key") == F.col("mark"), "left_semi")
    hits = kept(hits.withColumn("mark", F.xxhash64("key")))
    checksums = [F.bit_xor("mark").alias("x"), F.sum(F.shiftright("mark", 20)).alias("y")]  # buckets of the same classes need one comparison
    once = dealt.groupBy("bucket", "size").agg(*checksums).groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = dealt.join(once, "bucket").join(hits.select("mark", "key", "sig"), "mark")
    members = block_pairs(members, "bucket", "size", "key", BUCKET_BLOCK).where("n_blocks = 1 or low < high")
    cut = threshold - 4 * (threshold * (1 - threshold) / values) ** 0.5
    ordered = together(members.select("bucket", "low", "high", "key", "sig"), ["bucket", "low", "high"])
    return hits.drop("sig", "mark"), kept(ordered.mapInArrow(_similar(values, cut), "a binary, b binary"))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "low", "high"]):
            first: dict[bytes, np.ndarray] = {}
            keys = table.column("key").to_pylist()
            for start, sets, bounds in shingles.shingle_sets(table.column("line").combine_chunks()):
                for i in range(len(bounds) - 1):
                    own = sets[bounds[i] : bounds[i + 1]]
                    if keys[start + i] not in first and key_of(own) == keys[start + i]:
                        first[keys[start + i]] = own
            if len(first) < 2:
                continue
            names, sets = list(first), list(first.values())
            sizes = np.array([len(s) for s in sets])
            both = shingles.intersections(sets)
            linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            tree = forest(lambda i, others, linked=linked: linked[i, others], len(sets))
            yield pa.record_batch(
                [pa.array([names[i] for i, _ in tree], pa.binary()), pa.array([names[j] for _, j in tree], pa.binary())], names=["a", "b"]
            )

    return run


def verified(docs: DataFrame, text: str, doc: str, hits: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Links between classes of a cluster whose exact similarity reaches the threshold. One paragraph of each class is fetched by its place and its text's hash,
    since ids may repeat; its key is checked again."""
    size = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = clusters.join(size, "component").join(hits.select("key", "least"), F.col("node") == F.col("key"))
    members = members.select(
        "key", "component", "size", F.col("least.doc").alias("_doc"), F.col("least.th").alias("_th"), F.col("least.start").alias("_start"), F.col("least.end").alias("_end")
    )
    texts = _texts(docs, text, doc).join(members, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    lines = texts.select("key", "component", "size", F.substr("text", F.col("_start") + 1, F.col("_end") - F.col("_start")).alias("line"))
    dealt = block_pairs(lines, "component", "size", "key", CLUSTER_BLOCK).where("n_blocks = 1 or low < high")
    ordered = together(dealt.select(F.xxhash64("component").alias("cluster"), "low", "high", "key", "line"), ["cluster", "low", "high"], "key")
    return ordered.mapInArrow(_verified(threshold), "a binary, b binary")


def _runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words."""
    up, down = shingles.powers(len(hashes))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up)))
    return shingles.mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def _picked(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the places and hashes of the smallest run of GRAM words in every PASSAGE words of one text."""
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < PASSAGE:
        return none, none.astype(np.uint64)
    grams, windows = _runs_of(hashes, GRAM), np.flatnonzero(text[: len(text) - PASSAGE + 1] == text[PASSAGE - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - GRAM + 1)
    least = [part + view[part].argmin(axis=1) for part in (windows[low : low + 8192] for low in range(0, len(windows), 8192))]
    places = np.unique(np.concatenate(least)) if least else none
    return places, grams[places]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text with picked runs: their hashes and places as lists."""
    for batch in batches:
        for low, data, starts, hashes, text, first, _ in shingles.words_of(batch.column(2)):
            places, grams = _picked(hashes, text)
            before = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((data & 0xC0) != 0x80)))
            at = before[first[places]] - before[starts[text[places]]]
            has, begins = np.unique(text[places], return_index=True)
            bounds = np.concatenate((begins, [len(places)]))
            own = batch.select(["doc", "th"]).take(pa.array(low + has, pa.int64()))
            lists = _lists(grams.view(np.int64), bounds, pa.int64()), _lists(at, bounds, pa.int32())
            yield pa.record_batch([*own.columns, *lists], names=["doc", "th", "grams", "ats"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The picked runs that do not begin in a removed line, each with the number of equal rows in which that is so."""
    for batch in batches:
        picked, lines, copies = batch.column("picked"), batch.column("lines").to_pylist(), batch.column("copies").to_pylist()
        for i in range(batch.num_rows):
            at, one = np.unique(picked[i].values.field("at").to_numpy(), return_index=True)
            gram = picked[i].values.field("gram").to_numpy()[one]
            n = np.zeros(len(at), dtype=np.int32)
            for copy in range(min(copies[i], 2)):
                places = sorted((line["start"], line["end"]) for line in lines[i] or [] if copy or line["gone"])
                begins, ends = (np.array([place[k] for place in places], dtype=np.int64) for k in (0, 1))
                n += (np.searchsorted(begins, at, side="right") == np.searchsorted(ends, at, side="right")) * (copies[i] - 1 if copy else 1)
            has = np.flatnonzero(n)
            own = batch.select(["doc", "th"]).take(pa.array(np.full(len(has), i)))
            yield pa.record_batch([*own.columns, *map(pa.array, (gram[has], at[has], n[has]))], names=["doc", "th", "gram", "at", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of PASSAGE words that hold a picked run and no removed line. Of `copies` equal rows the first (`copy` 0) has the lines that are kept, the others none
    of the lines that repeat; each of the rows gives its share of both. One row per text and copy, with lists."""
    for batch in batches:
        picked, lines, copies = batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for i in range(batch.num_rows):
            text = batch.column(2).slice(i, 1)
            data, starts = shingles.text_bytes(text)
            hashes, _, first, last = shingles.word_hashes(data, starts)
            code_points = np.cumsum((data & 0xC0) != 0x80)
            start, end = code_points[first] - 1, code_points[last]
            n = len(hashes) - PASSAGE + 1
            near = np.zeros(n + 1, dtype=np.int64)
            places = np.searchsorted(start, picked[i].values.to_numpy())
            np.add.at(near, np.maximum(places + GRAM - PASSAGE, 0), 1)
            np.add.at(near, np.minimum(places + 1, n), -1)
            near, whole = np.cumsum(near)[:n] > 0, _runs_of(hashes, PASSAGE)
            for copy in range(min(copies[i], 2)):
                open_ = near.copy()
                for line in lines[i] or []:
                    if copy or line["gone"]:
                        a, b = np.searchsorted(start, (line["start"], line["end"]))
                        open_[max(a - PASSAGE + 1, 0) : b] = False
                at = np.flatnonzero(open_)
                if len(at):
                    columns = [pa.array([copy], pa.int32()), pa.array([copies[i]], pa.int32())]
                    lists = (whole[at].view(np.int64), pa.int64()), (at, pa.int32()), (start[at], pa.int32()), (end[at + PASSAGE - 1], pa.int32())
                    columns += [_lists(values, np.array([0, len(at)]), kind) for values, kind in lists]
                    yield pa.record_batch([*batch.select(["doc", "th"]).slice(i, 1).columns, *columns], names=["doc", "th", "copy", "copies", "grams", "ats", "starts", "ends"])


def passages(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Repeated passages in the texts `(doc, th, text)` beside the removals of `lines(doc, th, start, end, removed)`: rows `doc`, `start`, `end`, `first_doc`, `first_start`
    (where the span's first window stands first), `n` (places of its most frequent window) and `removed`. Only sums and minima are taken by hash."""
    picked = kept(texts.mapInArrow(_fingerprints, "doc long, th long, grams array<long>, ats array<int>"))
    picked = picked.select("doc", "th", F.inline(F.arrays_zip("grams", "ats"))).withColumnsRenamed({"grams": "gram", "ats": "at"})
    several = picked.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    hits = picked.join(several, "gram", "left_semi").groupBy("doc", "th").agg(F.collect_list(F.struct("at", "gram")).alias("all"))
    hits = hits.withColumn("copies", (F.size("all") / F.size(F.array_distinct("all.at"))).cast("int")).withColumnRenamed("all", "picked")
    gone = lines.groupBy("doc", "th", "start", "end").agg(F.min("removed").alias("gone"))
    gone = gone.groupBy(F.col("doc").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("start", "end", "gone")).alias("lines"))
    hits = hits.join(gone, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    hits = kept(hits.select("doc", "th", "picked", "lines", "copies"))
    freed(texts.sparkSession)
    left = hits.mapInArrow(_left, "doc long, th long, gram long, at int, n int")
    several = left.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    left = left.join(several, "gram", "left_semi").groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list("at").alias("places"))
    left = left.join(hits.drop("picked"), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th"))).drop("doc", "th")
    found = texts.join(left, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc", "th", "text", "places", "lines", "copies")
    schema = "doc long, th long, copy int, copies int, grams array<long>, ats array<int>, starts array<int>, ends array<int>"
    found = kept(found.mapInArrow(_windows, schema))  # as lists, a fifth of what a row per window takes
    freed(texts.sparkSession)
    found = found.select("doc", "th", "copy", "copies", F.inline(F.arrays_zip("grams", "ats", "starts", "ends")))
    found = found.withColumnsRenamed({"grams": "gram", "ats": "pos", "starts": "start", "ends": "end"})
    weight = F.when(F.col("copy") == 0, 1 / F.col("copies")).otherwise((F.col("copies") - 1) / F.col("copies"))
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "start", "th", "copy", "pos")
    several = found.groupBy("gram").agg(F.round(F.sum(weight)).cast("long").alias("n"), F.min(place).alias("first")).where("n > 1")
    same_text = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th")) & (F.col("copy") == F.col("first.copy"))
    found = found.join(several, "gram").withColumn("apart", ~same_text | (F.col("pos") >= F.col("first.pos") + PASSAGE))
    found = found.withColumn("removed", ~(same_text & (F.col("pos") == F.col("first.pos"))))
    repeats = found.where("removed and apart").select("gram").distinct()  # a window that only overlaps itself is no repeat
    found = found.where("apart or not removed").join(repeats, "gram", "left_semi")
    text_of = Window.partitionBy("doc", "th", "copy", "removed").orderBy("pos")
    found = found.withColumn("begins", F.coalesce(F.col("pos") > F.lag("pos").over(text_of) + PASSAGE, F.lit(False)).cast("int"))
    found = found.withColumn("span", F.sum("begins").over(text_of.rowsBetween(Window.unboundedPreceding, 0)))
    spans = found.groupBy("doc", "th", "copy", "copies", "removed", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("n"), F.min_by("first", "pos").alias("first")
    )
    spans = spans.withColumn("_again", F.explode(F.sequence(F.lit(1), F.when(F.col("copy") == 1, F.col("copies") - 1).otherwise(1))))
    return spans.select("doc", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"), "n", "removed")


def repeated(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, least: int = LEAST_WORDS
) -> DataFrame:
    """One row per paragraph of a cluster, and per span of repeated passages beside the removed lines: `doc`, `start`, `end` (code points), `class_doc`, `class_start` (first place of its class), `cluster_doc`,
    `cluster_start` (first place of its cluster), `n_paragraphs` in the cluster, and `removed`: false for the one that is kept."""
    bands, rows = tuned(threshold, recall, MOST_VALUES)
    texts = _texts(docs, text, doc)
    signed = texts.mapInArrow(_paragraphs(least, bands * rows), "doc long, th long, start int, end int, key binary, sig binary")
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "start", "end", "th")
    sets = kept(signed.groupBy("key").agg(F.min(place).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig")))
    freed(docs.sparkSession)
    hits, links = colliding(sets, threshold, bands, rows)
    clusters = kept(components(links))
    freed(docs.sparkSession)
    groups = components(verified(docs, text, doc, hits, clusters, threshold)).withColumnRenamed("node", "key")
    linked = hits.join(groups, "key").select("key", "least", "copies", "component")
    copied = sets.where("copies > 1").join(groups, "key", "left_anti").select("key", "least", "copies", F.col("key").alias("component"))
    named = kept(linked.union(copied))
    freed(docs.sparkSession)
    whole = named.groupBy("component").agg(F.min("least").alias("first"), F.sum("copies").alias("n_paragraphs"))
    named = named.join(whole, "component").select("key", "least", "first", "n_paragraphs")
    found = texts.mapInArrow(_paragraphs(least, 0), "doc long, th long, start int, end int, key binary")  # cheaper than keeping all places from before
    members = found.join(named, "key")
    at_first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("start") == F.col("first.start")) & (F.col("th") == F.col("first.th"))
    members = kept(members.withColumn("is_first", at_first))
    freed(docs.sparkSession)
    tied = Window.partitionBy("key", "doc", "start", "end").orderBy("is_first")  # repeated rows of one document: one of them is kept
    first = members.where("is_first").withColumn("removed", F.row_number().over(tied) > 1)
    others = members.where("not is_first").withColumn("removed", F.lit(True))
    lines = first.unionByName(others)
    inside = passages(texts, lines.select("doc", "th", "start", "end", "removed"))
    return lines.select(
        "doc", "start", "end", F.col("least.doc").alias("class_doc"), F.col("least.start").alias("class_start"),
        F.col("first.doc").alias("cluster_doc"), F.col("first.start").alias("cluster_start"), "n_paragraphs", "removed",
    ).union(inside.select("doc", "start", "end", "first_doc", "first_start", "first_doc", "first_start", "n", "removed"))
