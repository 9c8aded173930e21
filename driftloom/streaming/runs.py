"""Sums by key that grow with a stream, kept as runs that are merged now and then."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


class Runs:
    """A table (keys, sums) as runs: one for every batch, and merged ones.

    Run (level, i) holds the sums of batches i * fan ** level up to the next
    multiple. A batch writes its own run and no other, but for the last of every
    `fan` batches, which also merges them, the last of every fan * fan, which
    merges those, and so on: a row is written once for every level, not once for
    every batch. Reading adds up at most (fan - 1) runs of each level.

    A batch that is run again writes its runs, and the merges it ends, once more
    from the same input. Runs it merged are dropped by the batch after it, when
    it cannot come again. A run counts from when Spark has marked it complete.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sums: Sequence[str], fan: int = 8):
        if fan < 2:
            raise ValueError("a merge needs two runs at least")
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        self.keys, self.sums = list(keys), list(sums)

    def path(self, level: int, i: int) -> str:
        return f"{self.root}/run-{level}-{i}"

    def added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def add(self, batch: DataFrame, number: int) -> None:
        """Add the sums of batch `number`, 0, 1, …; batches come in order, any of them more than once in a row."""
        self._drop_merged(number)
        self.added(batch).write.mode("overwrite").parquet(self.path(0, number))
        level, done = 0, number + 1
        while done % self.fan == 0:
            parts = [self.spark.read.parquet(self.path(level, i)) for i in range(done - self.fan, done)]
            level, done = level + 1, done // self.fan
            self.added(reduce(DataFrame.unionByName, parts)).write.mode("overwrite").parquet(self.path(level, done - 1))

    def covering(self, batches: int) -> list[tuple[int, int]]:
        """The runs that together hold the first `batches` batches: those of the highest level first."""
        level = 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        out, start = [], 0
        for k in range(level, -1, -1):
            while start + self.fan**k <= batches:
                out.append((k, start // self.fan**k))
                start += self.fan**k
        return out

    def complete(self) -> set[tuple[int, int]]:
        """The runs that were written to their end."""
        path, system = self._files("run-*/_SUCCESS")
        names = [str(f.getPath().getParent().getName()) for f in system.globStatus(path)]
        return {(int(level), int(i)) for _, level, i in (n.split("-") for n in names)}

    def batches(self) -> int:
        """Batches added so far."""
        return max(((i + 1) * self.fan**level for level, i in self.complete()), default=0)

    def table(self, batches: int | None = None) -> DataFrame:
        """(keys, sums) of the batches so far, or of the first ones while their runs are still there."""
        runs = self.covering(self.batches() if batches is None else batches)
        if not runs:
            raise ValueError("no batch has been added")
        return self.added(reduce(DataFrame.unionByName, [self.spark.read.parquet(self.path(*r)) for r in runs]))

    def _files(self, pattern: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _drop_merged(self, number: int) -> None:
        """Remove runs that a merge of an earlier batch holds as well."""
        needed = set(self.covering(number))
        for level, i in self.complete() - needed:
            if (i + 1) * self.fan**level <= number:
                path, system = self._files(f"run-{level}-{i}")
                system.delete(path, True)


def add_counts(runs: Runs, counted: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: add what `counted` makes of a batch."""

    def each(batch: DataFrame, number: int) -> None:
        runs.add(counted(batch), number)

    return each
