"""Packing token sequences: bounded-space online packing.

Every task keeps a fixed number of open windows. A document is cut into full windows and one rest; the rest goes to the open window that it
fills best, and where none has room, the fullest window is emitted and a new one opened. What is still open at the end of a task is merged with the
leftovers of other tasks: leftovers are laid one after another and cut at the window's length, in groups of a bounded number of tasks, and the last
window of each group goes on to the next round, until one group is left.

Results: a null or empty text is a document with one token, the separator. Documents without id and repeated rows are packed like any
other. Ties between equally full windows go to the oldest. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm.graph import kept, runs
from plumeline.llm.tokens import chunks, encoder

WINDOW = 1024
OPEN_WINDOWS = 64
SEPARATOR = 0
BATCH_ROWS = 1000  # documents that Spark and a worker hold at once
MERGE_TASKS = 64  # tasks whose leftovers meet in one group of a round

PIECES = "doc long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, window long, offset long, open boolean, task long"


class Windows:
    """Open windows, best fit, the fullest emitted when a rest fits in none."""

    def __init__(self, most: int, length: int):
        self.most, self.length = most, length
        self.rooms: list[tuple[int, int]] = []  # (room left, number), in order
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, piece: list, n: int) -> list[tuple[int, list]]:
        """Places one piece of n tokens; the windows that this closes."""
        if n == self.length:
            self.next += 1
            return [(self.next - 1, [piece])]
        closed = []
        at = bisect_left(self.rooms, (n, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                _, full = self.rooms.pop(0)
                closed.append((full, self.held.pop(full)))
            room, number = self.length, self.next
            self.next += 1
            self.held[number] = []
        self.held[number].append(piece)
        if room == n:
            closed.append((number, self.held.pop(number)))
        else:
            insort(self.rooms, (room - n, number))
        return closed


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = [part.split()[0] for part in PIECES.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _laid(number: int, pieces: list, task: int, still_open: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        yield doc, start, n, crc32(ids), total, ids if still_open else None, task << 32 | number, offset, still_open, task
        offset += n


def _packed(path: str, length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, task = encoder(path), Windows(most, length), TaskContext.get().partitionId()
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        out: list[tuple] = []
        for batch in batches:
            for low, texts in chunks(batch.column(1)):
                ids, bounds = words.laid(texts)
                for i, doc in enumerate(batch.column(0).slice(low, len(texts)).to_pylist()):
                    whole = ids[bounds[i] : bounds[i + 1]].tobytes() + end
                    total = len(whole) // 4
                    for start in range(0, total, length):
                        own = whole[start * 4 : (start + length) * 4]
                        for number, pieces in windows.place([doc, start, own, total], len(own) // 4):
                            out += _laid(number, pieces, task, False)
                    if len(out) >= 8192:
                        yield _rows(out)
                        out = []
        for number, pieces in windows.held.items():
            out += _laid(number, pieces, task, True)
        yield _rows(out)
        words.forget()  # an idle worker holds little

    return run


def _merged(length: int, round_no: int, last: bool):
    """Leftovers laid one after another and cut at the window's length; the last window stays open but in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["group"]):
            group = table.column("group")[0].as_py()
            number, filled, out, held = 0, 0, [], []
            for row in table.to_pylist():
                start, ids = row["start"], row["ids"]
                while ids:
                    own = ids[: (length - filled) * 4]
                    held.append((row["doc"], start, own, row["doc_tokens"]))
                    ids, start, filled = ids[len(own) :], start + len(own) // 4, filled + len(own) // 4
                    if filled == length:
                        out += _laid(number, held, round_no << 26 | group, False)
                        number, filled, held = number + 1, 0, []
            out += _laid(number, held, round_no << 26 | group, not last)
            yield _rows([(*r[:-1], group) for r in out])

    return run


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows for what is planned inside; both ends of the pipe hold a batch. The session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = int(before)
    spark.conf.set(name, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc: str = "doc_id",
    length: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge_tasks: int = MERGE_TASKS,
) -> DataFrame:
    """One row per piece: `doc`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`. `tokenizer` is the vocabulary's path,
    which must be the same on every machine. The placing is written to the checkpoint folder once, so a rerun task can't give another one."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    with _small_batches(docs.sparkSession):
        placed = kept(rows.mapInArrow(_packed(tokenizer, length, open_windows), PIECES))
    done, rest = placed.where("not open"), placed.where("open")
    tasks, round_no = rest.agg(F.max("task")).first()[0], 1
    while tasks is not None:
        last = tasks < merge_tasks
        grouped = rest.withColumn("group", F.floor(F.col("task") / merge_tasks).cast("long"))
        groups = grouped.repartition("group").sortWithinPartitions("group", "task", "window", "offset")
        merged = kept(groups.mapInArrow(_merged(length, round_no, last), PIECES))
        done, rest = done.union(merged.where("not open")), merged.where("open")
        tasks, round_no = None if last else rest.agg(F.max("task")).first()[0], round_no + 1
    return done.select("doc", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
