"""The general data problems on small fixtures, against plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomlake.operators.containers import CONTAINER, clean_path, committed_path, index, index_table, lookup, lookup_all, pack, unpack, write_archive
from loomlake.operators.once import SeenStore, repeated
from loomlake.operators.publish import Folder
from loomlake.operators.orphans import orphan_fields, orphan_references
from loomlake.operators.skew import join_split
from loomlake.session import shared_path


def test_orphans_by_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, None), (4, "z", None), (5, "a", 9), (5, "a", 9), (6, None, 2)], "id int, x string, y int").withColumn("at", F.lit("2024-01-02").cast("timestamp")).withColumn("_live", F.lit(7))
    targets = spark.createDataFrame([("a", 1, "2024-01-01", None), ("b", 2, "2024-03-01", None), ("b", 3, "2024-01-01", "2024-01-05")], "x string, y int, arrived string, gone string")
    targets = targets.withColumn("arrived", F.col("arrived").cast("timestamp")).withColumn("gone", F.col("gone").cast("timestamp"))

    def run(match):
        return sorted((r.id, r.kind) for r in orphan_references(refs.drop("_live"), targets, ["x", "y"], "at", "arrived", "gone", match).collect())

    assert run("simple") == [(5, "missing"), (5, "missing")]
    assert run("partial") == [(4, "missing"), (5, "missing"), (5, "missing"), (6, "late")]
    assert run("full") == [(2, "malformed"), (4, "malformed"), (5, "missing"), (5, "missing"), (6, "malformed")]
    assert orphan_references(refs.limit(0), targets, ["x", "y"], "at", "arrived", "gone").count() == 0
    assert orphan_references(refs, targets.limit(0), ["x", "y"], "at", "arrived", "gone").count() == 3
    with pytest.raises(ValueError):
        orphan_references(refs, targets, ["x"], "at", "arrived", "gone", "other")


def test_join_split_with_a_hot_key(spark):
    rows = spark.range(9000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))))
    summary = rows.select("k").distinct().filter("k <> 'k7'").withColumn("n", F.length("k"))
    got = join_split(rows, summary, ["k"])
    assert got.count() == 9000
    assert got.filter("n is null").count() == rows.filter("k = 'k7'").count()
    assert got.exceptAll(rows.join(summary, ["k"], "left").select(*got.columns)).count() == 0


def test_containers_give_every_byte_back(spark):
    rng = random.Random(3)
    files = [(f"/f/{k}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 30, 400])))) for k in range(300)] + [("/f/big", b"x" * 5000), ("/f/1", b"again"), (None, None)]
    packed = pack(spark.createDataFrame(files, "path string, content binary").repartition(3), "path", "content", 1000).cache()
    back = [(r.path, bytes(r.content)) for r in unpack(packed).collect()]
    assert sorted(back, key=repr) == sorted(((p, c or b"") for p, c in files), key=repr)
    assert all(r.bytes <= 1000 or r.files == 1 for r in packed.collect())
    assert {(r.path, r.length, r.crc) for r in index(packed).collect()} == {(p, len(c or b""), zlib.crc32(c or b"")) for p, c in files}
    assert sorted(bytes(r.content) for r in unpack(packed, ["/f/1"]).collect()) == sorted([dict(files[:300])["/f/1"], b"again"])
    assert pack(spark.createDataFrame([], "path string, content binary"), "path", "content").count() == 0
    broken = packed.withColumn("payload", F.lit(b"no"))
    with pytest.raises(Exception, match="damaged"):
        unpack(broken).collect()


def test_paths(spark):
    good = ["hdfs://h:8020/a//b/./c=1/part-0.json", "/a/b%3D1/x.json"]
    bad = ["/a/.staging-1/x.json", "/a/_temporary/0/x.json", "/user/u/.Trash/Current/x.json", "/a/x.json._COPYING_", "/a/.x.json.tmp", "/a/.inprogress-1", "", None]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string").withColumn("c", clean_path(F.col("p")))
    rows = {r.p: (r.c, r.ok) for r in df.withColumn("ok", F.coalesce(committed_path(F.col("c")), F.lit(False))).collect()}
    assert rows[good[0]] == ("/a/b/c=1/part-0.json", True) and rows[good[1]] == ("/a/b=1/x.json", True)
    assert not any(rows[b][1] for b in bad)


def test_messages_once_over_batches(spark):
    store = SeenStore(spark, shared_path(spark, "test-seen"), shards=4)
    rng = random.Random(5)
    seen, key = set(), 0
    for _ in range(3):
        batch = []
        for _ in range(400):
            key += 1
            batch.append((key, rng.choice([None, "hot", f"m{rng.randrange(150)}"]), rng.randrange(5)))
        df = spark.createDataFrame(batch, "key long, id string, rank int")
        dropped = {r.key for r in repeated(df, F.col("id"), F.struct("rank", -F.col("key")), "key", store).collect()}
        want = set()
        for i in {b[1] for b in batch if b[1]}:
            own = sorted((b for b in batch if b[1] == i), key=lambda b: (-b[2], b[0]))
            want |= {b[0] for b in (own if i in seen else own[1:])}
            seen.add(i)
        assert dropped == want
    assert store.bitmaps().selectExpr("sum(bitmap_count(bits)) n").first().n == len(seen)
    assert store.dictionary().select("shard", "code").distinct().count() == store.dictionary().count() == len(seen)
    empty = spark.createDataFrame([], "key long, id string, rank int")
    assert repeated(empty, F.col("id"), F.struct("rank", "key"), "key", store).count() == 0


def _batch(spark, rows):
    return spark.createDataFrame(rows, "key long, id string, rank int")


def test_a_kill_between_the_steps_loses_nothing_and_a_replay_takes_nothing(spark):
    path = shared_path(spark, "test-replay")
    rank = F.struct("rank", -F.col("key"))
    rows = _batch(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1)])
    first = SeenStore(spark, path, 4)
    left = first.prepare(rows, F.col("id"), rank, "key", "1")  # killed before the commit
    assert sorted(r.key for r in first.arrivals(left, "key").collect()) == [2, 3]
    again = SeenStore(spark, path, 99)
    assert again.shards == 4 and again.versions() == [] and again.dictionary().count() == 2  # sighted, not accepted
    assert sorted(r.key for r in again.take(rows, F.col("id"), rank, "key", "1").collect()) == [2, 3]
    assert sorted(r.key for r in SeenStore(spark, path).take(rows, F.col("id"), rank, "key", "1").collect()) == [2, 3]  # its own arrivals once more
    assert SeenStore(spark, path).take(rows, F.col("id"), rank, "key", "another").count() == 0
    assert sorted(r.key for r in again.take(_batch(spark, [(9, "b", 5), (10, "c", 1)]), F.col("id"), rank, "key", "2").collect()) == [10]
    with pytest.raises(FileExistsError):  # a second writer that prepared on an older state
        first.commit(left)


def test_bits_decide_and_a_base_keeps_them(spark):
    store = SeenStore(spark, shared_path(spark, "test-base"), 2, base_every=2)
    rank = F.struct("rank", "key")
    for k in range(5):
        got = store.take(_batch(spark, [(10 * k, "old", 1), (10 * k + 1, f"n{k}", 1)]), F.col("id"), rank, "key", f"b{k}")
        assert sorted(r.key for r in got.collect()) == ([0, 1] if k == 0 else [10 * k + 1])
    assert store.bitmaps().selectExpr("sum(bitmap_count(bits)) n").first().n == 6
    # Without its bits the dictionary alone lets an identifier through again.
    Folder(spark, store.path).delete("seen-commits")
    assert sorted(r.key for r in store.take(_batch(spark, [(99, "old", 1)]), F.col("id"), rank, "key").collect()) == [99]


def test_small_files_are_replaced_at_once_or_refused(spark):
    folder = Folder(spark, shared_path(spark, "test-folder"))
    folder.put("a", "1")
    folder.put("a", "2")
    assert folder.get("a") == "2"
    with pytest.raises(FileExistsError):
        folder.put_new("a", "3")
    assert folder.get("a") == "2" and [n for n in folder.names() if not n.startswith(".")] == ["a"]


def test_lookup_reads_the_containers_of_the_index(spark):
    root = shared_path(spark, "test-archive")
    files = [(f"/f/{k:03d}", bytes([k % 256]) * 50) for k in range(200)] + [("/f/007", b"again")]
    df = spark.createDataFrame(files, "path string, content binary")
    write_archive(pack(df, "path", "content", 500), root)
    write_archive(pack(spark.createDataFrame([("/g/1", b"later")], "path string, content binary"), "path", "content"), root)  # appended
    assert index_table(spark, root).count() == 202
    held = spark.read.schema(CONTAINER).parquet(f"{root}/containers")
    assert held.select("container_id").distinct().count() == held.count()
    assert sorted(bytes(r.content) for r in lookup(spark, root, ["/f/007", "/g/1", "/none"]).collect()) == sorted([b"\x07" * 50, b"again", b"later"])
    assert lookup(spark, root, []).count() == 0
    plan = lookup(spark, root, ["/f/007"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(container_id" in plan or "In(container_id" in plan
    wanted = spark.createDataFrame([("/f/001",), ("/f/150",), ("/f/001",)], "p string")
    assert sorted(r.path for r in lookup_all(spark, root, wanted, "p").collect()) == ["/f/001", "/f/150"]


def test_the_lookup_query_reads_every_file_of_the_archive(spark):
    from loomlake.plans.quality import p4_index, p4_lookup

    d = "/root/testdata/sf0.001"
    got = p4_lookup(spark, d).selectExpr("path", "octet_length(record) as bytes")
    want = p4_index(spark, d)
    assert got.count() == want.count() > 5 and got.exceptAll(want).count() == 0


def test_each_present_column_is_a_reference(spark):
    refs = spark.createDataFrame([(1, "a", None), (2, "z", "k"), (3, None, None), (4, "late", "gone"), (4, "late", "gone")], "id int, x string, y string").withColumn("at", F.lit("2024-01-02").cast("timestamp"))

    def side(rows):
        return spark.createDataFrame(rows, "key string, arrived string, deleted string").select("key", F.col("arrived").cast("timestamp"), F.col("deleted").cast("timestamp"))

    targets = {"x": side([("a", "2024-01-01", None), ("late", "2024-02-01", None), ("late", None, "2024-01-01")]), "y": side([("k", None, None), ("gone", "2023-01-01", "2024-01-01")])}
    got = sorted((r.id, r.fld, r.kind) for r in orphan_fields(refs, targets, "at").collect())
    assert got == [(2, "x", "missing"), (4, "x", "late"), (4, "x", "late"), (4, "y", "deleted"), (4, "y", "deleted")]
    assert orphan_fields(refs.limit(0), targets, "at").count() == 0


def test_intermediate_tables_can_be_dropped_one_by_one(spark):
    from loomlake.session import discard, written

    a, b = (written(spark.range(5).toDF("k"), f"test-{n}") for n in "ab")
    discard(a)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(a._written_at).count()
    assert b.count() == 5


def test_a_cluster_without_a_shared_folder_is_refused():
    from loomlake.session import shared_root

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())
