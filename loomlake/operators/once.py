"""Problem 6: messages delivered at least once, kept exactly once.

A store has two parts that are committed apart:

* the **dictionary** encodes identifiers exactly: a shard by hash, then dense codes within the shard. It is extended as soon as a
  batch shows new identifiers. A code says only that an identifier was sighted.
* the **seen bitmaps**, 32,768 bits a row by (shard, bucket), compressed at rest, say which codes were accepted. Each version adds
  the bits of its batch; the seen set is their union, and every ``base_every``-th version writes that union as a new base.

A batch is reduced to one arrival per identifier (a partial aggregate, so a message delivered a million times never meets in one
task), encoded, and tested against the bitmaps: arrivals at unset bits are selected. ``prepare`` leaves them in a draft;
``commit`` unites the bits by one exclusive rename. Whatever is lost between the two steps, the batch finds its codes in the
dictionary and its bits unset, and comes out again. A batch that was committed before gives the arrivals of its own version, so
a replay delivers the same rows and takes nothing new.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators.publish import Folder


@dataclass(frozen=True)
class Prepared:
    """A batch's arrivals, and whether its version is committed already."""

    batch: str
    folder: str
    number: int
    base: bool
    done: bool


class SeenStore:
    """path: a folder that all executors share. shards: fixed by the first use of the path and read from it ever after; a shard's
    new identifiers are numbered in one task, so choose them for the identifiers of a batch (a million a shard is a light task)."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 256, base_every: int = 16):
        self.spark, self.path, self.base_every = spark, path.rstrip("/"), base_every
        self.folder = Folder(spark, self.path)
        if not self.folder.exists("shards"):
            try:
                self.folder.put_new("shards", str(shards))
            except FileExistsError:
                pass
        self.shards = int(self.folder.get("shards"))

    def _commits(self, kind: str) -> list[dict]:
        """Committed entries of one part in their order; each is a small file of its own number, made by one exclusive rename."""
        return sorted((json.loads(t) for t in self.folder.get_all(f"{kind}-commits")), key=lambda c: c["number"])

    def versions(self) -> list[dict]:
        return self._commits("seen")

    def dictionary(self) -> DataFrame | None:
        """(shard, id, code) of every identifier ever sighted."""
        at = [f"{self.path}/{c['folder']}" for c in self._commits("dictionary")]
        return self.spark.read.schema("shard int, id string, code long").parquet(*at) if at else None

    def bitmaps(self) -> DataFrame | None:
        """(shard, bucket, bits): the union of all bits since the last base."""
        v = self.versions()
        if not v:
            return None
        since = max((k for k, c in enumerate(v) if c["base"]), default=0)
        rows = self.spark.read.schema("shard int, bucket long, bits binary").parquet(*[f"{self.path}/{c['folder']}/bits" for c in v[since:]])
        return rows.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _encode(self, ids: DataFrame) -> None:
        """Extends the dictionary by the identifiers (shard, id) that it does not know."""
        entries = self._commits("dictionary")
        known = self.dictionary()
        new = ids if known is None else ids.join(known.select("shard", "id"), ["shard", "id"], "left_anti")
        following = {int(s): n for s, n in entries[-1]["next"].items()} if entries else {}
        number = F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1
        start = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps({str(s): n for s, n in following.items()})), "map<string,bigint>"), F.col("shard").cast("string")), F.lit(0))
        at = f"dictionary-{uuid.uuid4().hex}"
        new.select("shard", "id", (start + number).cast("long").alias("code")).write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        added = self.spark.read.schema("shard int, id string, code long").parquet(f"{self.path}/{at}").groupBy("shard").agg(F.max("code").alias("last")).collect()  # a row a shard
        if added:
            following |= {r["shard"]: r["last"] + 1 for r in added}
            k = len(entries)
            self.folder.put_new(f"dictionary-commits/{k:09d}", json.dumps({"number": k, "folder": at, "next": following}))

    def prepare(self, rows: DataFrame, identifier: Column, rank: Column, key: str, batch: str | None = None) -> Prepared:
        """Selects one arrival per identifier whose bit is unset and leaves (key) and the new bits in a draft; nothing is accepted yet."""
        batch = uuid.uuid4().hex if batch is None else str(batch)
        versions = self.versions()
        for c in versions:
            if c["batch"] == batch:
                return Prepared(batch, c["folder"], c["number"], c["base"], True)
        best = rows.select(identifier.cast("string").alias("id"), rank.alias("rank"), F.col(key).alias("key")).filter(F.col("id").isNotNull())
        best = best.groupBy("id").agg(F.max(F.struct("rank", "key")).alias("b")).select(F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int").alias("shard"), "id", F.col("b.key").alias("key"))
        at = f"version-{uuid.uuid4().hex}"
        best.write.option("compression", "zstd").parquet(f"{self.path}/{at}/best")
        best = self.spark.read.schema(best.schema).parquet(f"{self.path}/{at}/best")
        self._encode(best.select("shard", "id"))
        known = self.dictionary()
        number, base = len(versions), len(versions) % self.base_every == self.base_every - 1
        if known is None:  # no identifier was ever sighted
            chosen = best.select("shard", "key", F.lit(0).cast("long").alias("code")).filter("false")
        else:
            chosen = best.join(known, ["shard", "id"]).select("shard", "key", "code")
        chosen = chosen.withColumns({"bucket": F.bitmap_bucket_number("code"), "bit": F.bitmap_bit_position("code")})
        seen = self.bitmaps()
        if seen is not None:
            byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            unset = F.col("bits").isNull() | (F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 0)
            chosen = chosen.join(seen, ["shard", "bucket"], "left").filter(unset)
        chosen.select("shard", "bucket", "bit", "key").write.option("compression", "zstd").parquet(f"{self.path}/{at}/arrivals")
        taken = self.spark.read.parquet(f"{self.path}/{at}/arrivals")
        bits = taken.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        if base and seen is not None:
            bits = bits.unionByName(seen).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.option("compression", "zstd").parquet(f"{self.path}/{at}/bits")
        return Prepared(batch, at, number, base, False)

    def arrivals(self, prepared: Prepared, key: str) -> DataFrame:
        """(key) of the arrivals that the batch's version holds."""
        return self.spark.read.parquet(f"{self.path}/{prepared.folder}/arrivals").select(F.col("key").alias(key))

    def commit(self, prepared: Prepared) -> None:
        """Unites the batch's bits with the seen set. Refused (FileExistsError) if another writer committed since ``prepare``."""
        if not prepared.done:
            entry = {"number": prepared.number, "batch": prepared.batch, "folder": prepared.folder, "base": prepared.base}
            self.folder.put_new(f"seen-commits/{prepared.number:09d}", json.dumps(entry))

    def take(self, rows: DataFrame, identifier: Column, rank: Column, key: str, batch: str | None = None) -> DataFrame:
        """Commits one arrival per unseen identifier and returns (key) of these arrivals.

        rank: the arrival with the greatest rank is kept, so it must tell any two copies apart. Rows with a null identifier take no
        part. An empty batch takes nothing. batch: its name; a name that was committed before returns what it took then.
        """
        prepared = self.prepare(rows, identifier, rank, key, batch)
        self.commit(prepared)
        return self.arrivals(prepared, key)


def repeated(rows: DataFrame, identifier: Column, rank: Column, key: str, store: SeenStore, batch: str | None = None) -> DataFrame:
    """Keys of the rows to drop: those with an identifier that are not among the arrivals the store took from this batch."""
    kept = store.take(rows, identifier, rank, key, batch)
    return rows.filter(identifier.isNotNull()).select(key).join(kept, key, "left_anti")
