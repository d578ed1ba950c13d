"""State kept in a folder: rows committed by batch number, drawn together now and then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Kept:
    """A table of batches that reads as one.

    A batch is committed under its number, in a folder that is overwritten if the batch is run again. Every
    ``every`` batches all rows are drawn together by ``merge`` into a base, which counts from the moment
    its mark is written: before that the batches count, afterwards the base does in their
    place, and a batch at or below the mark that comes again is left out. So a failure at any
    point loses and doubles nothing. The base before the last and its batches are deleted, so that files stay few.

    ``close`` may split the merged rows into those that go on and a second table, drawn together with what that held.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], every: int = 8, close: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] | None = None):
        self.spark, self.folder, self.merge, self.every, self.close = spark, folder, merge, every, close

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the batches, bases or marks that are there."""
        fs, at = self._fs(), self._path(kind)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def mark(self) -> int:
        """The last batch that the base holds; -1 before there is one."""
        return max(self._numbers("marks"), default=-1)

    def commit(self, batch: DataFrame, number: int) -> None:
        mark = self.mark()
        if number <= mark:
            return
        batch.write.mode("overwrite").parquet(f"{self.folder}/batches/{number}")
        if number - mark >= self.every:
            self.compact(number)

    def _read(self, mark: int, part: str) -> DataFrame | None:
        path = f"{self.folder}/bases/{mark}/{part}"
        return self.spark.read.parquet(path) if mark >= 0 and self._fs().exists(self._path("bases", str(mark), part)) else None

    def rows(self) -> DataFrame:
        """All rows committed so far, merged; those that ``close`` has taken out are not among them."""
        mark = self.mark()
        out = self._read(mark, "rows")
        for number in self._numbers("batches"):
            if number > mark:
                one = self.spark.read.parquet(f"{self.folder}/batches/{number}")
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError(f"nothing is kept in {self.folder} yet")
        return self.merge(out)

    def closed(self) -> DataFrame | None:
        return self._read(self.mark(), "closed")

    def compact(self, number: int) -> None:
        """Draws all batches up to ``number`` into one base."""
        before, rows = self.mark(), self.rows()
        if self.close is not None:
            rows, closed = self.close(rows, self.closed())
            closed.write.mode("overwrite").parquet(f"{self.folder}/bases/{number}/closed")
        rows.write.mode("overwrite").parquet(f"{self.folder}/bases/{number}/rows")
        fs = self._fs()
        fs.create(self._path("marks", str(number)), True).close()
        for kind in ("bases", "marks", "batches"):
            for n in self._numbers(kind):
                if n <= before if kind == "batches" else n < before:
                    fs.delete(self._path(kind, str(n)), True)
