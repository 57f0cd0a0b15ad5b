"""Problem 4: far too many small files, packed into indexed archive containers.

A container holds the unchanged bytes of many files one after the other; its index says path, offset, length and checksum
of each, so that any file can be cut out again and proved whole. Containers are rows of a Parquet table: one row per
container with the payload as binary, so that they are read in parallel. ``write_archive`` puts them beside an index table sorted by
path; ``lookup`` reads from the index which containers hold a path and from the containers these alone. Packing streams: a task
holds one open container, whatever the number of files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.spelling import tidy

_INDEX = "array<struct<path:string,offset:bigint,length:bigint,crc:bigint>>"
CONTAINER = f"container_id string, payload binary, files int, bytes bigint, entries {_INDEX}"


def clean_path(path: Column) -> Column:
    """A path without scheme and authority, percent-decoded, without empty and '.' segments."""
    bare = F.regexp_replace(tidy(path), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    bare = F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B"))
    bare = F.regexp_replace(bare, r"/(\./)+", "/")
    return F.regexp_replace(bare, r"/(\.?/)+", "/")


def committed_path(path: Column) -> Column:
    """True for a clean path of which no segment is hidden, temporary, staged, trashed or half-copied."""
    low = F.lower(path)
    return (F.length(path) > 0) & ~low.rlike(r"(^|/)[._]") & ~low.rlike(r"(\._copying_|\.(tmp|temp|inprogress|crc|part|swp|bak)|~)$") & ~low.rlike(r"(^|/)(tmp|temp|staging|trash)(/|$)")


def _pack(block_bytes: int, run: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        buffer, entries = bytearray(), []

        def close() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{run}-{part:06d}-{seq:06d}"]), pa.array([bytes(buffer)], pa.binary()), pa.array([len(entries)], pa.int32()), pa.array([len(buffer)], pa.int64()), pa.array([entries], kind)],
                names=["container_id", "payload", "files", "bytes", "entries"],
            )

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py() or b""
                if entries and len(buffer) + len(raw) > block_bytes:
                    yield close()
                    seq += 1
                    buffer, entries = bytearray(), []
                entries.append({"path": path, "offset": len(buffer), "length": len(raw), "crc": zlib.crc32(raw)})
                buffer += raw
        if entries:
            yield close()

    return pack


def pack(files: DataFrame, path: str, content: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Containers of the files (``path``, ``content`` binary); a file larger than ``block_bytes`` gets a container of its own.

    Null content counts as no bytes; null paths are kept as null; paths may repeat, each row is one entry. An empty table
    gives no container. Ids begin with a name of this packing, so archives can be appended to one another.
    """
    run = uuid.uuid4().hex[:12]
    return files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(_pack(block_bytes, run), CONTAINER)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, entries in zip(batch.column(0), batch.column(1).to_pylist()):
            view = memoryview(payload.as_buffer())
            paths, raws = [], []
            for e in entries:
                raw = bytes(view[e["offset"] : e["offset"] + e["length"]])
                if len(raw) != e["length"] or zlib.crc32(raw) != e["crc"]:
                    raise ValueError(f"container entry {e['path']} is damaged")
                paths.append(e["path"])
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], names=["path", "content"])


def unpack(containers: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The files (path, content) again, each proved by its checksum; with ``paths`` only these."""
    chosen = containers
    if paths is not None:
        wanted = F.array(*[F.lit(p) for p in paths]) if paths else F.array().cast("array<string>")
        chosen = containers.withColumn("entries", F.filter("entries", lambda e: F.array_contains(wanted, e["path"]))).filter(F.size("entries") > 0)
    return chosen.select("payload", "entries").mapInArrow(_unpack, "path string, content binary")


def write_archive(containers: DataFrame, root: str, row_group_bytes: int = 8 << 20) -> None:
    """containers/ and index/ below root: row groups of a few containers in the order of their ids; the index sorted by path."""
    containers.write.mode("append").option("parquet.block.size", row_group_bytes).option("compression", "zstd").parquet(f"{root}/containers")
    stored = containers.sparkSession.read.schema(CONTAINER).parquet(f"{root}/containers")
    index(stored).repartitionByRange(F.col("path")).sortWithinPartitions("path").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(f"{root}/index")


def lookup(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The files (path, content) of the given paths, read from the containers that hold them alone.

    Both filters are pushed to the scans: the paths to the sorted index, the ids found there to the containers. A path that is not
    in the archive gives no row, a repeated one all its entries. For more paths than a request names use ``lookup_all``.
    """
    rows = index_table(spark, root).filter(F.col("path").isin(*paths)) if paths else index_table(spark, root).filter("false")
    held = sorted({r["container_id"] for r in rows.select("container_id").collect()})  # no more than the request's own entries
    stored = spark.read.schema(CONTAINER).parquet(f"{root}/containers")
    return unpack(stored.filter(F.col("container_id").isin(*held)) if held else stored.filter("false"), paths)


def index_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("container_id string, path string, offset long, length long, crc long").parquet(f"{root}/index")


def lookup_all(spark: SparkSession, root: str, wanted: DataFrame, path: str) -> DataFrame:
    """As ``lookup`` for a table of paths: entries are joined to the containers by id, nothing comes to the driver."""
    entries = index_table(spark, root).join(wanted.select(F.col(path).alias("path")).distinct(), "path", "left_semi")
    own = entries.groupBy("container_id").agg(F.collect_list(F.struct("path", "offset", "length", "crc")).alias("entries"))  # no more than the container's own files
    stored = spark.read.schema(CONTAINER).parquet(f"{root}/containers").select("container_id", "payload")
    return stored.join(own, "container_id").select("payload", "entries").mapInArrow(_unpack, "path string, content binary")


def index(containers: DataFrame) -> DataFrame:
    """One row per file: container_id, path, offset, length, crc."""
    return containers.select("container_id", F.inline("entries"))


def containers_for(files: DataFrame, path: str, content: str, bytes_total: int, file_bytes: int = 128 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """Containers spread over as many partitions (and so output files) as ``bytes_total`` fills at ``file_bytes`` each."""
    return pack(files.repartition(max(1, -(-bytes_total // file_bytes))), path, content, block_bytes)
