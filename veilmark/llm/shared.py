"""Small helpers of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that the innermost open ``scratch`` deletes at its end.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset.

    On a cluster a local warehouse is no such folder: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not named and not spark.sparkContext.master.startswith("local"):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost nothing.

    Inside ``scratch`` the table goes at its end; else it stays until ``clear``.
    """
    path = _new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: str) -> DataFrame:
    """As ``settled``, of all ``parts`` in one table: each is written before the next is asked for."""
    path = _new_path(spark)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/veilmark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if (paths := _OPEN.get()) is not None:
        paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables settled inside; the function it gives settles one that outlives it."""
    outer, own = _OPEN.get(), []
    _OPEN.set(own)

    def keep(df: DataFrame) -> DataFrame:
        _OPEN.set(outer)
        try:
            return settled(df)
        finally:
            _OPEN.set(own)

    try:
        yield keep
    finally:
        _OPEN.set(outer)
        for path in own:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes what the operators of this application left in the shared folder; their results cannot be read any more."""
    _delete(spark, f"{shared_folder(spark)}/veilmark-{spark.sparkContext.applicationId}")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(batches: Iterator[pa.RecordBatch], max_chars: int = 1 << 19) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in slices of about ``max_chars`` bytes, so that memory does not follow the batch size; null text is ''."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lengths = texts.nbytes // max(1, len(texts)) + 1
        step = max(1, max_chars // lengths)
        for at in range(0, len(texts), step):
            yield ids.slice(at, step).to_pylist(), [t or "" for t in texts.slice(at, step).to_pylist()]
        pa.default_memory_pool().release_unused()


def column_ddl(df: DataFrame, name: str, as_name: str | None = None) -> str:
    return f"`{as_name or name}` {df.schema[name].dataType.simpleString()}"


def map_texts(df: DataFrame, one: Callable[[str], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row ``(id, *one(text))`` for each row; other columns, whatever their names, are not read."""
    ddl = f"{column_ddl(df, id_col)}, {schema}"
    out = pa_schema(ddl)

    def run(batches):
        for ids, texts in text_batches(batches):
            rows = [one(t) for t in texts]
            yield arrow([ids, *zip(*rows, strict=True)], out)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def arrow(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` from its columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB in place of Spark's default of 64 MB, so that two tasks fit a small executor; a value set by the user stays.

    A setting of the session: the registered queries and stages call this, the operators do not.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(key, "4m")


def pa_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``ddl``, for a function that runs on (small) batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
