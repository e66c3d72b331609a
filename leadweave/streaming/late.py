"""Facts that come in late, as a stream: the newest of each domain, whatever is replayed.

Each micro-batch is written to a folder of its own number, which a replay of that batch overwrites with the same
rows. The state is the newest row of each domain over all batches, so a batch costs what it holds and not what is
stored; compacting writes the state as one batch and starts a new store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def newest(facts: DataFrame) -> DataFrame:
    """The row of each domain with the greatest observed_at (of equals, the greatest row); all columns as they were.

    Null domains are left out; a null time is the oldest.
    """
    columns = [c for c in facts.columns if c not in ("domain", "observed_at")]
    row = F.struct("observed_at", *[F.col(f"`{c}`") for c in columns])
    best = facts.filter("domain IS NOT NULL").groupBy("domain").agg(F.max(row).alias("row"))
    return best.select("domain", "row.*").select(*[F.col(f"`{c}`") for c in facts.columns])


def upsert_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest facts of a batch, in the folder of its number."""

    def write(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(number)}")

    return write


def upsert_facts(facts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start keeping the newest facts of a stream (domain, observed_at, ...; no maps) in the store at `path`.

    checkpoint: a shared folder; trigger: as for DataStreamWriter.trigger, such as availableNow=True.
    """
    writer = facts.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_facts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest facts of each domain in the store."""
    return newest(spark.read.schema(schema).option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*").select(*schema.names))


def compact(spark: SparkSession, path: str, schema: StructType, to: str) -> None:
    """Write the state as the first batch of a new store, so that reading costs no more than the domains.

    A stream goes on there with a checkpoint of its own; its batches count from 0, so the state is kept apart as -1.
    """
    current_facts(spark, path, schema).write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch=-1")
