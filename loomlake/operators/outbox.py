"""K-10: a queue in a folder: events enqueued once per page, delivered, and marked by what the receiver acknowledged.

Three append-only parts, each batch a folder of its own: what was enqueued (a ``SeenStore`` by page decides, so a replayed batch adds
nothing), acknowledgements, and errors. An event's state is what these say of it, so no row is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators.once import SeenStore
from loomlake.operators.publish import Folder

ACK = "event_id string, delivered_at timestamp, partition int, offset long"
ERROR = "event_id string, error string"


class Outbox:
    """path: a folder that all executors share. page: the column whose value is queued once (a canonical URL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, page: str = "url", event: str = "event_id"):
        self.spark, self.path, self.schema, self.page, self.event = spark, path.rstrip("/"), schema, page, event
        self.folder, self.store = Folder(spark, self.path), SeenStore(spark, f"{self.path}/seen", 16)

    def _part(self, name: str, schema: str) -> DataFrame:
        own = Folder(self.spark, f"{self.path}/{name}").names()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{n}" for n in own]) if own else self.spark.createDataFrame([], schema)

    def enqueue(self, events: DataFrame, rank: Column, batch: str) -> None:
        """Queues the event of greatest rank for each page not queued before; rows without a page are left out."""
        rows = events.filter(F.col(self.page).isNotNull())
        prepared = self.store.prepare(rows, F.col(self.page), F.struct(rank.alias("r"), F.col(self.event).alias("e")), self.event, batch)
        kept = rows.join(self.store.arrivals(prepared, self.event), self.event, "left_semi").dropDuplicates([self.event])
        kept.write.mode("overwrite").parquet(f"{self.path}/queued/{batch}")
        self.store.commit(prepared)

    def events(self) -> DataFrame:
        """All queued events with state, delivered_at, attempts: pending until acknowledged."""
        acks = self._part("acks", ACK).groupBy("event_id").agg(F.min("delivered_at").alias("delivered_at"), F.count(F.lit(1)).alias("_a"))
        errors = self._part("errors", ERROR).groupBy("event_id").agg(F.count(F.lit(1)).alias("_e"))
        q = self._part("queued", self.schema).join(acks.withColumnRenamed("event_id", self.event), self.event, "left").join(errors.withColumnRenamed("event_id", self.event), self.event, "left")
        return q.withColumns({"state": F.when(F.col("_a").isNotNull(), "sent").otherwise("pending"), "attempts": F.coalesce("_a", F.lit(0)) + F.coalesce("_e", F.lit(0))}).drop("_a", "_e")

    def publish(self, deliver: Callable[[DataFrame], tuple[DataFrame, DataFrame]], order: list, limit: int, run: str) -> None:
        """Hands the first ``limit`` pending events to ``deliver``, which returns acknowledgements and errors; both are appended under the run's
        name. An event without either stays pending; delivered twice it is acknowledged twice and sent once."""
        acks, errors = deliver(self.events().filter("state = 'pending'").orderBy(*order).limit(limit))
        acks.write.mode("overwrite").parquet(f"{self.path}/acks/{run}")
        errors.write.mode("overwrite").parquet(f"{self.path}/errors/{run}")


def paused(pending: DataFrame, bytes_of: Column, most_rows: int = 10_000, most_bytes: int = 10 << 30) -> DataFrame:
    """ST-10: (rows, bytes, paused) of what is pending: collection pauses at either bound."""
    n = pending.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bytes_of), F.lit(0)).alias("bytes"))
    return n.withColumn("paused", (F.col("rows") >= most_rows) | (F.col("bytes") >= most_bytes))
