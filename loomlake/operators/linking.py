"""X-05: surface forms linked to names by exact spelling, else by the one best similarity ratio.

The ratio of two texts of m and n characters is 2M / (m + n), M the characters that match in order. At ratio r or more at most
(1 - r)(m + n) characters are unmatched, so the shorter differs from the longer in at most k = (1 - r)(m + n) single steps: cut into k + 1
segments, one of them stands unharmed in the other, moved by k places at most. Names are indexed by their segments; surfaces look up their
own substrings of those lengths. Candidates that meet are measured one by one; all of it is joins, nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import normal_name


def steps(n: int, ratio: float) -> int:
    """The most unmatched characters of a name of n characters and any text that reaches the ratio with it."""
    longest = n * (2 - ratio) / ratio  # 2n / (n + m) >= ratio
    return int((1 - ratio) * (n + longest) + 1e-9)


def cuts(n: int, ratio: float) -> list[tuple[int, int]]:
    """(start, length) of the segments of a name of n characters; none if they would be empty."""
    k = steps(n, ratio) + 1
    if n < k:
        return []
    edges = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _index(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seg, start, size = [], [], [], []
            for k, t in enumerate(batch.column(0).to_pylist()):
                for a, n in cuts(len(t), ratio):
                    at.append(k), seg.append(t[a : a + n]), start.append(a), size.append(len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(seg, pa.string()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["name", "seg", "start", "size"])

    return run


def _look(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seg, start, size = [], [], [], []
            for k, t in enumerate(batch.column(0).to_pylist()):
                asked = set()
                for n in range(int(len(t) * ratio / (2 - ratio)), int(len(t) * (2 - ratio) / ratio) + 2):
                    far = steps(n, ratio)
                    for a, length in cuts(n, ratio):
                        for p in range(max(0, a - far), min(len(t) - length, a + far) + 1):
                            asked.add((t[p : p + length], a, n))
                for s, a, n in asked:
                    at.append(k), seg.append(s), start.append(a), size.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(seg, pa.string()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["form", "seg", "start", "size"])

    return run


def _ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = [SequenceMatcher(None, b, a, autojunk=False).ratio() for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r, pa.float64())], names=["form", "name", "ratio"])


def link_surfaces(surfaces: DataFrame, surface: str, names: DataFrame, name: str, key: str, blocked: DataFrame | None = None, ratio: float = 0.9) -> DataFrame:
    """(surface, key, method, ratio): each distinct surface that means one key.

    Spellings are compared as ``normal_name`` has them. An exact name counts if it is one key's alone, and a surface with an exact name is never linked by
    likeness. Else the keys of the best ratio from ``ratio`` on count, if they are one. blocked: one column of spellings that are linked to nothing. Null and
    empty spellings are linked to nothing; repeated rows change nothing.
    """
    s = surfaces.select(F.col(surface).cast("string").alias("surface")).filter("surface is not null").distinct().withColumn("form", normal_name(F.col("surface"))).filter("form <> ''")
    n = names.select(normal_name(F.col(name)).alias("name"), F.col(key).cast("string").alias("key")).filter("name is not null and name <> '' and key is not null").distinct()
    if blocked is not None:
        s = s.join(blocked.select(normal_name(F.col(blocked.columns[0])).alias("form")).distinct(), "form", "left_anti")
    one = n.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key"))
    exact = s.join(one.withColumnRenamed("name", "form"), "form")
    linked = exact.filter("k = 1").select("surface", "key", F.lit("exact").alias("method"), F.lit(1.0).alias("ratio"))
    rest = s.join(one.select(F.col("name").alias("form")), "form", "left_anti")
    index = n.select("name").distinct().mapInArrow(_index(ratio), "name string, seg string, start int, size int")
    asked = rest.select("form").distinct().mapInArrow(_look(ratio), "form string, seg string, start int, size int")
    pairs = asked.join(index, ["seg", "start", "size"]).select("form", "name").distinct().mapInArrow(_ratio, "form string, name string, ratio double").filter(F.col("ratio") >= ratio)
    hits = pairs.join(n, "name").groupBy("form", "key").agg(F.max("ratio").alias("ratio"))
    best = hits.groupBy("form").agg(F.max("ratio").alias("ratio"))
    sole = hits.join(best, ["form", "ratio"]).groupBy("form", "ratio").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key")).filter("k = 1")
    return linked.unionByName(rest.join(sole, "form").select("surface", "key", F.lit("near").alias("method"), F.round("ratio", 6).alias("ratio")))
