"""Micro-batch ingest (ST-01 to ST-09, K-08, K-09, S-07): a checkpointed stream, idempotent sinks, exactly-once by identifier.

The source is any stream with the landed schema; a Kafka source needs its connector on the class path, files need nothing. A
batch is known by its number: writing it again overwrites the same folder, so a replay after a failure leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators.dq import contract
from loomlake.operators.once import SeenStore

EVENT = "event_id string, source string, url string, title string, collected_at timestamp, partition int, offset bigint"
RULES = ("event_id", "source", "url", "title", "collected_at")


def kafka_source(spark: SparkSession, servers: str, topic: str, most: int = 2000) -> DataFrame:
    """S-07, ST-02, ST-03, ST-10: bounded batches; lost offsets fail the query. Needs the Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = raw.option("failOnDataLoss", "true").option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load()
    body = F.from_json(F.col("value").cast("string"), EVENT)
    return raw.select(body.alias("b"), "partition", "offset").select(*[F.col(f"b.{c}") for c in ("event_id", "source", "url", "title", "collected_at")], "partition", "offset")


def file_source(spark: SparkSession, path: str, schema: str = EVENT, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def land(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """K-08, K-09: valid rows and quarantine, partitioned by batch. Returns the running query."""

    def write(batch: DataFrame, number: int) -> None:
        valid, broken = contract(batch, {c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in RULES})
        valid.write.mode("overwrite").parquet(f"{root}/valid/batch={number}")
        broken.write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 seconds")).start()


def once_sink(root: str, store: SeenStore):
    """The foreachBatch function of ``land_once``: prepare, write the rows, commit the identifiers, in this order.

    A batch is named by its number. Killed before the commit, its replay finds the identifiers unseen and writes the same rows over
    what was left; killed after it, the replay reads the arrivals of the batch's own version. Either way each arrival is landed once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_key", F.concat_ws(":", "event_id", "partition", "offset", F.unix_micros("collected_at")))
        rank = F.struct(F.coalesce("collected_at", F.lit("1970-01-01").cast("timestamp")).alias("t"), "offset", "partition")
        prepared = store.prepare(batch, F.col("event_id"), rank, "_key", f"batch-{number}")
        # The same arrival may stand in the batch twice (a replay), so its key alone is not yet one row.
        batch.join(store.arrivals(prepared, "_key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key").write.mode("overwrite").parquet(f"{root}/batch={number}")
        store.commit(prepared)

    return write


def land_once(stream: DataFrame, root: str, checkpoint: str, store: SeenStore):
    """ST-01, ST-04, ST-05: of each identifier the first batch's best arrival (newest, then highest offset) is landed, in whatever batches it comes."""
    return stream.writeStream.foreachBatch(once_sink(root, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, root: str, checkpoint: str, key: str):
    """ST-06 to ST-08: a table by key that batches replace. Each batch appends the newest row of its own keys, a folder named by its number, so a
    replay overwrites itself and no batch rewrites the table; ``state`` reads it, ``compact`` folds what has gathered."""

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch, key).write.mode("overwrite").parquet(f"{root}/d={number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame, key: str) -> DataFrame:
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("collected_at", "offset")).alias("r")).select(key, "r.*")


def _folders(spark: SparkSession, root: str) -> list[str]:
    """The newest base, if any, and the batches after it."""
    from loomlake.operators.publish import Folder

    names = Folder(spark, root).names()
    done = {n[5:] for n in names if n.startswith("DONE-")}
    base = max((n for n in names if n.startswith("b=") and n[2:] in done), default=None)
    own = [n for n in names if n.startswith("d=") and (base is None or n[2:] > base[2:])]
    return ([base] if base else []) + sorted(own)


def state(spark: SparkSession, root: str, key: str, cancelled: F.Column | None = None) -> DataFrame:
    """The newest row of each key over all batches, the cancelled left out."""
    rows = _newest(spark.read.parquet(*[f"{root}/{n}" for n in _folders(spark, root)]), key)
    return rows if cancelled is None else rows.filter(~cancelled)


def compact(spark: SparkSession, root: str, key: str) -> None:
    """Folds the batches so far into one base, valid once its marker is there; the folded batches stay until the next sweep of the folder."""
    from loomlake.operators.publish import Folder

    last = _folders(spark, root)[-1][2:]
    state(spark, root, key).write.mode("overwrite").parquet(f"{root}/b={last}")
    Folder(spark, root).put(f"DONE-{last}", "")


def offset_faults(progress: DataFrame, bounds: DataFrame) -> DataFrame:
    """ST-03: (partition, fault) of the partitions that must not be read on: ``gap`` (the next offset is older than what is kept), ``truncated``
    (it lies behind the end), ``commit_ahead`` (the receiver committed more than was landed), ``unknown`` (no such partition).

    progress: (partition, next_offset, committed); bounds: (partition, low, high), high exclusive. Null committed is none.
    """
    fault = (
        F.when(F.col("low").isNull(), "unknown").when(F.col("next_offset") < F.col("low"), "gap").when(F.col("next_offset") > F.col("high"), "truncated").when(F.col("committed") > F.col("next_offset"), "commit_ahead")
    )
    return progress.join(bounds, "partition", "left").select("partition", fault.alias("fault")).filter("fault is not null")


def checked(progress: DataFrame, bounds: DataFrame) -> None:
    """Refuses to start (ValueError) if any partition has a fault; at most a few are named."""
    bad = offset_faults(progress, bounds).orderBy("partition").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"partition {r['partition']}: {r['fault']}" for r in bad))


def poll_changes(feed: DataFrame, key: str, status: str, at: str, since: str, until: str, overlap: str = "15 minutes") -> DataFrame:
    """ST-06: the newest state of each key among the changes from ``overlap`` before ``since`` up to ``until``; ties by status. Polls overlap, so late changes
    are seen by the next one, and applying a state twice changes nothing."""
    window = feed.filter((F.col(at) >= F.expr(f"timestamp_ntz'{since}' - interval {overlap}")) & (F.col(at) < F.lit(until).cast("timestamp_ntz")))
    return window.groupBy(key).agg(F.max_by(F.struct(*[c for c in feed.columns if c != key]), F.struct(at, status)).alias("r")).select(key, "r.*")


def apply_changes(state: DataFrame | None, changes: DataFrame, key: str, at: str) -> DataFrame:
    """The state after the changes: a change replaces a row that is not newer. Cancelled keys stay as such, so an older change cannot revive them."""
    if state is None:
        return changes
    both = state.withColumn("_o", F.lit(0)).unionByName(changes.withColumn("_o", F.lit(1)))
    cols = [c for c in state.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, "_o")).alias("r")).select(key, "r.*")


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Event-time counts with a watermark: an extension over plain look-backs."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
