"""Tables replayed as streams: landed in parts, run until nothing is left, restarted from the checkpoint."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from bidframe.sources.scratch import folder
from bidframe.sources.tabular import append_batch
from bidframe.streaming.stateful import STATE_STORE


@contextlib.contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], mode: str = "append", partitions: int = 8) -> DataFrame:
    """All rows that ``stream`` says about ``parts``, each of which lands before a run of its own.

    Every run starts anew from the checkpoint. Its batches are written under
    their number, so one that runs twice leaves its rows once. The table has
    the batch number as its last column. ``partitions`` is the number of parts
    of the state; it holds for the life of a checkpoint.
    """
    spark = parts[0].sparkSession
    base = f"{folder(spark)}/replay-{uuid.uuid4().hex}"
    landed, out = f"{base}/in", f"{base}/out"
    with _settings(spark, **{STATE_STORE[0]: STATE_STORE[1], "spark.sql.shuffle.partitions": str(partitions)}):
        schema = None
        for part in parts:
            part.write.mode("append").parquet(landed)
            rows = stream(spark.readStream.schema(part.schema).parquet(landed))
            schema = rows.schema
            query = (rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
                     .foreachBatch(lambda df, number: append_batch(df, out, number)).start())
            query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(out)
