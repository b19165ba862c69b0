"""Helpers that the corpus operators share: words, durable tables, tasks' files."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.sources.tables import new_folder, shared_folder

# Functions of this package travel to the executors with their tasks.
cloudpickle.register_pickle_by_value(sys.modules["balance_spark.llm"])

#: White space between words; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(text: Column) -> Column:
    """The words of a text in order; NULL and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def fresh(table: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that the table does not have yet."""
    taken = {c.lower() for c in table.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        made.append(name)
    return made


def durable(table: DataFrame) -> DataFrame:
    """Compute ``table`` once, into the shared folder, and go on from there.

    The files survive the loss of executors; Spark removes them with the DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(table.sparkSession)
    return table.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_file(filesystem, folder: str, suffix: str, write) -> tuple[str, int]:
    """Write one file of a task under a name of its own, then put it in place.

    ``write(stream)`` gets an open stream.  A task that runs again puts the same content in
    the same place, so nothing is there twice.
    """
    task = TaskContext.get()
    part, attempt = task.partitionId(), task.taskAttemptId()
    rough, final = f"{folder}/.part-{part:05d}-{attempt}", f"{folder}/part-{part:05d}{suffix}"
    filesystem.create_dir(folder, recursive=True)
    with filesystem.open_output_stream(rough, compression=None) as stream:
        write(stream)
        size = stream.tell()
    filesystem.move(rough, final)
    return final, size


class Texts:
    """The strings of an Arrow column as one byte array with the place of each word.

    Words are found for the whole batch at once: ``starts`` and ``ends`` are byte offsets,
    ``first`` has for each row (and once past the end) the number of words before it.
    """

    def __init__(self, column, folded: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        self.bounds = offsets[column.offset : column.offset + len(column) + 1]
        if not len(column):
            self.bounds = np.zeros(1, dtype=np.int64)
        low, high = int(self.bounds[0]), int(self.bounds[-1])
        held = column.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8)[low:high] if held else np.zeros(0, np.uint8)
        self.bounds = self.bounds - low
        if folded:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~_IS_BLANK[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A row may end and the next begin without a blank between them.
        cuts = self.bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        if len(cuts):
            cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        total = np.zeros(len(self.starts), dtype=np.uint64)
        place = np.arange(len(self.data), dtype=np.int64)
        place -= np.repeat(
            np.concatenate([[0], self.starts]),
            np.diff(np.concatenate([[0], self.starts, [len(self.data)]])),
        )
        value = _BYTE_CODES[self.data] * _PLACE_CODES[place % len(_PLACE_CODES)]
        value ^= value >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        total = sums[self.ends] - sums[self.starts]
        return mixed(total + lengths.astype(np.uint64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_PLACE_CODES = mixed(np.arange(1001, 2025, dtype=np.uint64)) | np.uint64(1)


def stored(table: DataFrame, name: str) -> DataFrame:
    """Like ``durable``, as a table of its own in the shared folder: smaller, for large rows.

    The folder belongs to the cluster's shared space and is cleared with it.
    """
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)
