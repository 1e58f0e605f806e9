"""Safe publication of masked output: two phases, one pointer, and a count of what went past the mask.

A batch is written whole to a folder of its own; then one small file, the
pointer, is replaced atomically and names that folder.  Readers follow the
pointer.  Wherever a job stops, the pointer names the last whole batch; a batch
that runs again writes its folder anew, or finds itself published.

The mask observes the rows that it passes on, the writer those that it writes.
If the numbers differ, rows came from elsewhere than the mask or were lost behind
it, and the batch is not published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class UnmaskedRows(RuntimeError):
    """The rows written are not those that were masked."""


class Masked:
    """Rows that left a mask: ``rows``, and their number once a job has run."""

    def __init__(self, rows: DataFrame):
        self._seen = Observation()
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("n"))

    def then(self, step) -> Masked:
        """The same count, with ``step`` applied to the rows: it may change columns, but no row may come or go."""
        other = object.__new__(Masked)
        other._seen, other.rows = self._seen, step(self.rows)
        return other

    @property
    def count(self) -> int:
        return self._seen.get["n"]


class Snapshots:
    """The published batches below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> str | None:
        """The folder that the pointer names."""
        if not self._store.exists(self._at(POINTER)):
            return None
        return self.spark.read.text(f"{self.path}/{POINTER}").first()[0]

    def read(self) -> DataFrame:
        """The last published batch; an error if there is none yet."""
        if (folder := self.current()) is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def publish(self, masked: Masked, batch_id: int = 0) -> bool:
        """Publishes a batch; false if it is published already.  Raises ``UnmaskedRows`` if what is written is not what was masked."""
        folder = f"batch-{batch_id:020d}"
        if self.current() == folder:
            return False
        self.write(masked, folder)
        self.point(folder)
        self.sweep(folder)
        return True

    def write(self, masked: Masked, folder: str) -> None:
        written = Observation()
        masked.rows.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        if (n := written.get["n"]) != (m := masked.count):
            self._store.delete(self._at(folder), True)
            raise UnmaskedRows(f"{n} rows were written, {m} were masked")

    def point(self, folder: str) -> None:
        """The pointer is written aside and put in place by one rename."""
        aside = self._at(f"{POINTER}-{folder}")
        out = self._store.create(aside, True)
        out.write(bytearray(folder, "utf-8"))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        way = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        way[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(self._store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, self._at(POINTER), way)

    def sweep(self, folder: str) -> None:
        """Deletes all batches but ``folder``."""
        for one in self._store.listStatus(self._at("")):
            name = one.getPath().getName()
            if name.startswith("batch-") and name != folder:
                self._store.delete(one.getPath(), True)


def publish_stream(stream: DataFrame, mask, path: str, checkpoint: str):
    """A query that masks each batch of ``stream`` and publishes it; batches count from 0, and one that runs again changes nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        Snapshots(batch.sparkSession, path).publish(Masked(mask(batch)), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
