"""Streams: masking without state, and a vault kept by session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.mask import mask_shapes, shape_hits
from ..operators.naming import adopted_base


def mask_stream(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Shapes masked, row by row: the same plan for a batch and for a stream."""
    return mask_shapes(messages, text_col)


def shape_events(messages: DataFrame, text_col: str = "text", end_col: str | None = None) -> DataFrame:
    """session_id, digest and base name of each shape met, in order of appearance where messages have ``seq``; digests, so that no state or checkpoint holds a value.

    A message whose ``end_col`` holds gives a row without digest, after its shapes.
    """
    seq = F.col("seq").cast("long") if "seq" in messages.columns else F.lit(0).cast("long")
    hits = F.transform(shape_hits(F.coalesce(F.col(text_col), F.lit(""))), lambda h: F.struct(h["start"].alias("start"), F.sha2(h["value"], 256).alias("digest"), adopted_base(h["kind"], h["hint"], h["hint"]).alias("base")))
    if end_col is not None:
        last = F.array(F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("base")))
        hits = F.when(F.col(end_col), F.concat(hits, last)).otherwise(hits)
    return messages.select("session_id", seq.alias("seq"), F.explode_outer(hits).alias("h")).where("h is not null").select("session_id", "seq", "h.start", "h.digest", "h.base")


def _adopt(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    digests, names = ([], []) if not state.exists else map(list, state.get)
    fresh, ended = [], False
    # One trigger's messages of one session; the state keeps at most ADOPT_CAP digests.
    for digest, base in pd.concat(batches).sort_values(["seq", "start", "digest"])[["digest", "base"]].itertuples(index=False):
        if digest is None:
            digests, names, ended = [], [], True
            continue
        ended = False
        if digest in digests or len(digests) >= R.ADOPT_CAP:
            continue
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}-{n}"
        digests.append(digest)
        names.append(name)
        fresh.append((key[0], digest, name))
    if ended:
        state.remove()
    else:
        state.update((digests, names))
    yield pd.DataFrame(fresh, columns=["session_id", "digest", "name"])


def adopt_stream(messages: DataFrame, text_col: str = "text", end_col: str | None = None) -> DataFrame:
    """Names adopted by session as messages come, each value once and at most ``ADOPT_CAP`` in a session; a message whose ``end_col`` holds drops the session's state."""
    return (
        shape_events(messages, text_col, end_col)
        .groupBy("session_id")
        .applyInPandasWithState(_adopt, "session_id string, digest string, name string", "digests array<string>, names array<string>", "append", "NoTimeout")
    )


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that its source holds now, written to files in the shared folder (``spark.checkpoint.dir``, else the warehouse) and read back."""
    spark = stream.sparkSession
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{shared}/veilmark-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
