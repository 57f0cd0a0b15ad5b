"""Queues, change feeds, guarded loads, splits and the boosted model on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import learning as L
from loomlake.operators import publish
from loomlake.operators.outbox import Outbox, paused
from loomlake.session import shared_path
from loomlake.streaming import ingest


def test_outbox_queues_a_page_once_and_keeps_what_was_not_acknowledged(spark):
    box = Outbox(spark, shared_path(spark, "test-outbox"), "event_id string, url string, o long")
    rows = spark.createDataFrame([("a", "u1", 1), ("b", "u1", 2), ("c", "u2", 1), ("d", None, 1)], "event_id string, url string, o long")
    assert box.events().count() == 0
    for batch in ("1", "1", "2"):  # replayed, then delivered again under another name
        box.enqueue(rows, F.col("o"), batch)
    assert sorted((r.event_id, r.state) for r in box.events().collect()) == [("b", "pending"), ("c", "pending")]

    def deliver(df):
        return df.filter("event_id = 'b'").select("event_id", F.lit("2024-01-01").cast("timestamp").alias("delivered_at"), F.lit(0).alias("partition"), F.lit(5).cast("long").alias("offset")), df.filter("event_id = 'c'").select("event_id", F.lit("no").alias("error"))

    box.publish(deliver, ["o"], 10, "r1")
    box.publish(deliver, ["o"], 10, "r2")
    assert sorted((r.event_id, r.state, r.attempts) for r in box.events().collect()) == [("b", "sent", 1), ("c", "pending", 2)]
    p = paused(box.events().filter("state = 'pending'"), F.length("url"), 1).first()
    assert (p.rows, p.bytes, p.paused) == (1, 2, True) and not paused(rows.limit(0), F.length("url")).first().paused


def test_offsets_that_must_not_be_read_on(spark):
    b = spark.createDataFrame([(0, 10, 20), (1, 10, 20), (2, 10, 20), (3, 10, 20), (4, 10, 20)], "partition int, low long, high long")
    p = spark.createDataFrame([(0, 9, None), (1, 21, None), (2, 12, 13), (3, 10, 10), (4, 20, None), (9, 0, None)], "partition int, next_offset long, committed long")
    assert sorted(tuple(r) for r in ingest.offset_faults(p, b).collect()) == [(0, "gap"), (1, "truncated"), (2, "commit_ahead"), (9, "unknown")]
    with pytest.raises(ValueError, match="partition 0: gap"):
        ingest.checked(p, b)
    ingest.checked(p.filter("partition in (3, 4)"), b)


def test_late_changes_come_with_the_overlap_and_repeats_change_nothing(spark):
    feed = spark.createDataFrame([(1, "Update", "2024-01-01 00:10:00", "x"), (1, "Cancelled", "2024-01-01 09:00:00", "x"), (1, "Update", "2024-01-01 08:00:00", "late"), (2, "Update", "2024-01-01 23:50:00", "y")], "k int, s string, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))

    def poll(since, until, seen=None):
        return ingest.poll_changes(feed if seen is None else feed.filter(seen), "k", "s", "t", since, until)

    state = ingest.apply_changes(None, poll("2024-01-01 00:00:00", "2024-01-02 00:00:00", "v <> 'late' and k = 1"), "k", "t")
    state = ingest.apply_changes(state, poll("2024-01-02 00:00:00", "2024-01-03 00:00:00"), "k", "t")  # 23:50 is within the overlap
    state = ingest.apply_changes(state, poll("2024-01-01 00:00:00", "2024-01-01 08:30:00"), "k", "t")  # older than what is known
    assert sorted((r.k, r.s) for r in state.collect()) == [(1, "Cancelled"), (2, "Update")]


def test_staged_load_and_its_guards(spark):
    stage = spark.createDataFrame([(1, "n1", 5.0), (2, "n2", 6.0), (3, "??", 7.0)], "id int, name string, score double")
    target = spark.createDataFrame([(1, 10, 0.0), (9, 90, 0.0)], "id int, company int, score double")
    known = spark.createDataFrame([("n1", 10), ("n2", 20)], "name string, company int")
    loaded, rejected = publish.staged_load(stage, target, known, "name", "id", 0.6)
    assert sorted(tuple(r) for r in loaded.collect()) == [(1, 10, 5.0), (2, 20, 6.0), (9, 90, 0.0)] and [r.id for r in rejected.collect()] == [3]
    again, _ = publish.staged_load(stage, loaded, known, "name", "id", 0.6)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in loaded.collect())
    for bad in ((stage, known, 0.9), (stage.union(stage), known, 0.1), (stage, known.union(known), 0.1)):
        with pytest.raises(ValueError):
            publish.staged_load(bad[0], target, bad[1], "name", "id", bad[2])


def test_parts_do_not_leak(spark):
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.product("abcdefgh", repeat=2)], "a string, b string").withColumn("p", L.split_by_pair(F.col("a"), F.col("b"), 30, 30))
    both = pairs.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q")), ["a", "b"])
    assert both.filter("p <> q").count() == 0 and pairs.select("p").distinct().count() == 3
    t = spark.createDataFrame([("1999-12-31",), ("2000-01-01",), ("2000-07-01",), (None,)], "d string").select(L.split_by_time(F.to_date("d"), "1999-12-31", "2000-06-30")).collect()
    assert [r[0] for r in t] == ["TRAIN", "VALID", "TEST", None]


def test_purge_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "delta", "공급", "계약", "추가"]

    def grams(t):
        t = "".join(c for c in t if c.isalnum())
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))}

    for threshold in (0.5, 0.8):
        seen = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))) for _ in range(25)] + ["ab", None]
        rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12)))) for k in range(60)] + [(100, "ab"), (101, None), (102, ""), (103, seen[0]), (103, seen[0])]
        got = sorted(r.k for r in L.purge_seen(spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame([(s,) for s in seen], "t string"), "k", "t", threshold).collect())
        want = sorted(k for k, t in rows if t is None or not any(s is not None and len(grams(t) & grams(s)) / min(len(grams(t)), len(grams(s))) >= threshold - 1e-9 for s in seen))
        assert got == want
    assert L.purge_seen(spark.createDataFrame(rows, "k int, t string").limit(0), spark.createDataFrame([], "t string"), "k", "t").count() == 0


def test_purge_is_the_same_in_any_number_of_blocks(spark):
    """Texts of one make, each with every other a pair: they leave block by block, and the one that is like none stays in all."""
    seen = spark.createDataFrame([(f"{k} agreed to build {k * 7} together with us",) for k in range(300)], "t string")
    rows = spark.createDataFrame([(k, f"{k} agreed to build {k * 5} together with them") for k in range(300)] + [(300, "quite another matter"), (301, None)], "k int, t string")
    for most in (900, 3_000_000):
        assert sorted(r.k for r in L.purge_seen(rows, seen, "k", "t", most=most).collect()) == [300, 301]


def test_boosted_trees_learn_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(1500):
        a, b = rng.random(), rng.random()
        y = "UP" if a > 0.6 and b > 0.3 else "DOWN" if a < 0.3 else "FLAT"
        rows.append((a, b if rng.random() > 0.05 else None, y if rng.random() > 0.05 else rng.choice(["UP", "DOWN", "FLAT"])))
    df = spark.createDataFrame(rows, "a double, b double, y string").withColumn("part", F.monotonically_increasing_id() % 3)
    model = L.Boosted(["a", "b"], "y", ["DOWN", "FLAT", "UP"], rounds=5, depth=3).fit(df.filter("part = 0"), df.filter("part = 1"))
    out = model.predict(df.filter("part = 2")).cache()
    assert out.filter("predicted = y").count() > 0.85 * out.count()
    sums = out.select(F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    grid = L.tau_grid(out, "y", (0.4, 0.6), "FLAT")
    assert L.choose_tau(grid, least=100) == 0.4 and L.choose_tau(grid, least=10**6) == 0.9
    empty = L.Boosted(["a", "b"], "y", ["DOWN", "UP"]).fit(df.limit(0), df.limit(0)).predict(df.limit(5))
    assert {tuple(r.probabilities) for r in empty.collect()} == {(0.5, 0.5)}
