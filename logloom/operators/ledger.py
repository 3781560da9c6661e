"""A run's rounds in the shared folder, so that a run that was cut off goes on where it was.

A round's frames are written first and its marker last, by renaming a finished file, so a round is there as a whole or not at all; a
round that was cut off is written again. A stop mark says why a run must not go on; it holds until it is lifted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARK, STOP = "COMPLETE", "STOPPED"


class Stopped(RuntimeError):
    """The run was stopped and its mark wasn't lifted."""


class Ledger:
    """The rounds of one run below a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        draft, final = (self._hadoop.Path(f"{self.path}/{x}") for x in (f"{name}.draft", name))
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise OSError(f"could not name {name}")

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._hadoop.Path(f"{self.path}/{name}"))

    def _round(self, k: int) -> str:
        return f"round-{k:05d}"

    def rounds(self) -> int:
        """How many rounds are whole, counted from the first."""
        k = 0
        while self._there(f"{self._round(k)}/{MARK}"):
            k += 1
        return k

    def save(self, k: int, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Writes a round, and gives its frames as they were written."""
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{self.path}/{self._round(k)}/{name}")
        self._write(f"{self._round(k)}/{MARK}", ",".join(frames))
        return {name: self.load(k, name, frame) for name, frame in frames.items()}

    def load(self, k: int, name: str, like: DataFrame | None = None) -> DataFrame:
        """A frame of a whole round."""
        read = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return read.parquet(f"{self.path}/{self._round(k)}/{name}")

    def stop(self, reason: str) -> None:
        """Marks the run as stopped; it doesn't go on before lift()."""
        self._write(STOP, reason)

    def lift(self) -> None:
        self._fs.delete(self._hadoop.Path(f"{self.path}/{STOP}"), False)

    def check(self) -> None:
        if self._there(STOP):
            stream = self._fs.open(self._hadoop.Path(f"{self.path}/{STOP}"))
            reason = bytes(stream.readAllBytes()).decode()
            stream.close()
            raise Stopped(reason)
