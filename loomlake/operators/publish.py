"""Publication: data first, attested, and one small file last that makes a run valid (K-01 to K-18, S-24, Q-09, Q-10).

A reader follows the pointer, so it sees the old version or the new one, never a part. Hashing runs on the executors, block by
block; the driver reads markers and manifests alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Files of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def _draft(self, text: str):
        draft = self.at(f".draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        return draft

    def _rename(self, draft, name: str, replace: bool) -> None:
        """One rename of the file system's own: it replaces the target at once, or refuses a target that exists."""
        jvm = self.jvm
        gateway = self.spark.sparkContext._gateway
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(kind, 1 if replace else 0)
        if replace:
            options[0] = kind.OVERWRITE
        self.fs.mkdirs(self.at(name).getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, self.at(name), options)

    def put(self, name: str, text: str) -> None:
        """Through a draft and one replacing rename: the name shows the old text or the new one, never half a text."""
        self._rename(self._draft(text), name, True)

    def put_new(self, name: str, text: str) -> None:
        """As ``put``, but a name that exists is refused (FileExistsError): of two writers one wins."""
        draft = self._draft(text)
        try:
            self._rename(draft, name, False)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise FileExistsError(f"{self.path}/{name}") from None
            raise

    def get(self, name: str) -> str:
        """A small file's text, read by the driver alone: no job."""
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def get_all(self, name: str) -> list[str]:
        """The texts of the small files in a folder, by name; none if there is no such folder. Drafts are left out."""
        folder = Folder(self.spark, f"{self.path}/{name}")
        return [folder.get(n) for n in folder.names() if not n.startswith(".")]

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.fs.exists(self.at("")) else []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with fs.open_input_stream(at) as f:
                while block := f.read(8 << 20):
                    h.update(block)
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Q-10: (file, bytes, sha256) of the data files below a path, file being relative to it. Files are read in blocks of 8 MB by
    the executors, so no file need fit a task."""
    root = Folder(spark, path).fs.makeQualified(Folder(spark, path).at("")).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.regexp_replace("path", r"^file:/+", "file:///").alias("path"), F.col("length").alias("bytes")).mapInArrow(_hashed, "path string, bytes long, sha256 string")
    return files.select(F.expr(f"substring(path, {len(re.sub(r'^file:/+', 'file:///', root)) + 2})").alias("file"), "bytes", "sha256")


def publish(df: DataFrame, root: str, as_of: str, keys: list[str], partition_by: list[str] | None = None) -> str:
    """K-03, K-11: write a run, read it back, attest counts and hashes, then mark it verified; returns the run's name.

    Refused: null or repeated keys, an as-of that is not newer than the last verified run's (Q-09). The same as-of with the same
    content is a retry and returns the run there is.
    """
    from loomlake.operators.dq import duplicate_keys, null_keys

    spark, folder = df.sparkSession, Folder(df.sparkSession, root)
    last = latest(spark, root)
    digest = df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    fingerprint = f"{digest['n']}:{digest['s']}"
    if last and last["as_of"] >= as_of:
        if last["as_of"] == as_of and last["fingerprint"] == fingerprint:
            return last["run"]
        raise ValueError(f"as-of {as_of} is not newer than {last['as_of']}")
    run = f"run-{as_of.replace(':', '').replace(' ', 'T')}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{run}/data")
    stored = spark.read.parquet(f"{root}/{run}/data")
    if stored.count() != digest["n"] or not null_keys(stored, keys).isEmpty() or not duplicate_keys(stored, keys).isEmpty():
        raise ValueError(f"{run}: rows are missing, or keys are null or repeated")
    inventory(spark, f"{root}/{run}/data").write.parquet(f"{root}/{run}/inventory")
    # The inventory is a table of its own, however many files there are; the manifest holds its order-free digest.
    own = F.sha2(F.concat_ws("|", "file", "bytes", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in range(4)]
    files = spark.read.parquet(f"{root}/{run}/inventory").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), *parts).first()
    attested = hashlib.sha256("|".join(str(files[f"d{k}"]) for k in range(4)).encode()).hexdigest()
    manifest = {"run": run, "as_of": as_of, "rows": digest["n"], "fingerprint": fingerprint, "files": files["files"], "bytes": files["bytes"], "sha256": attested}
    Folder(spark, f"{root}/{run}").put("manifest.json", json.dumps(manifest))
    folder.put(f"VERIFIED-{run}", json.dumps(manifest))
    return run


def latest(spark: SparkSession, root: str) -> dict | None:
    """S-24: the verified run with the newest as-of. Markers are small files that the driver reads itself."""
    folder = Folder(spark, root)
    marks = [json.loads(folder.get(n)) for n in folder.names() if n.startswith("VERIFIED-")]
    return max(marks, key=lambda m: (m["as_of"], m["run"]), default=None)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """K-15: (as_of, run, rows, status) of the verified runs: the newest is CURRENT, those before are SUPERSEDED. A run is a small file, so the list is the driver's."""
    folder = Folder(spark, root)
    marks = sorted((json.loads(folder.get(n)) for n in folder.names() if n.startswith("VERIFIED-")), key=lambda m: (m["as_of"], m["run"]))
    rows = [(m["as_of"], m["run"], m["rows"], "CURRENT" if m is marks[-1] else "SUPERSEDED") for m in marks]
    return spark.createDataFrame(rows, "as_of string, run string, rows long, status string")


def staged_load(stage: DataFrame, target: DataFrame, known: DataFrame, natural: str, key: str, least_resolved: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """K-21: (target after the load, rejected rows). Staged rows get the columns of ``known`` by their natural key; those without are rejected.

    Guards, checked before anything is changed (ValueError): a natural key that means two things, a repeated key in the stage, fewer than ``least_resolved``
    of the staged rows resolved. Loaded rows replace the target's of the same key; a second load of the same stage changes nothing.
    """
    from loomlake.operators.dq import duplicate_keys
    from loomlake.operators.serving import replace_keys

    if not duplicate_keys(known, [natural]).isEmpty():
        raise ValueError(f"{natural} is not unique")
    if not duplicate_keys(stage, [key]).isEmpty():
        raise ValueError(f"{key} is repeated in the stage")
    resolved = stage.join(known.withColumn("_known", F.lit(True)), natural, "left")
    n = resolved.agg(F.count(F.lit(1)).alias("n"), F.count("_known").alias("k")).first()
    if n["k"] < least_resolved * n["n"]:
        raise ValueError(f"only {n['k']} of {n['n']} staged rows have a key")
    good = resolved.filter("_known is not null").select(*target.columns)
    return replace_keys(target, good, [key]), resolved.filter("_known is null").select(*stage.columns)


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """K-04, U-04: equal rows with equal repeats."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def promote(frames: dict[str, DataFrame], root: str, run: str) -> None:
    """K-05: all datasets are written and read back before the one marker commits the group."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{run}/{name}")
        if not same_bag(df, spark.read.parquet(f"{root}/{run}/{name}")):
            raise ValueError(f"{name}: what was stored differs")
    Folder(spark, root).put(f"VERIFIED-{run}", json.dumps({"run": run, "as_of": run, "datasets": sorted(frames)}))


def precedence(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """X-38, K-18: what to do with each incoming document: (key, action).

    Columns of both: key, collected_at, hash, analysed. New keys are inserted, newer ones replace, older ones are skipped, a raw
    copy never replaces an analysed one, and the same time with another content is a conflict.
    """
    s = stored.select(F.col(key), F.col("collected_at").alias("t"), F.col("hash").alias("h"), F.col("analysed").alias("a"))
    j = incoming.join(s, key, "left")
    act = (
        F.when(F.col("t").isNull(), "insert")
        .when((F.col("collected_at") == F.col("t")) & (F.col("hash") != F.col("h")), "conflict")
        .when(F.col("hash") == F.col("h"), "keep")
        .when(F.col("a") & ~F.col("analysed"), "protected")
        .when(F.col("collected_at") > F.col("t"), "replace")
        .otherwise("stale")
    )
    return j.select(key, act.alias("action"))
