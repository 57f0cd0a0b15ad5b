"""Problem 3: references to records that do not exist.

References are grouped by the mask of their null columns; each mask is anti-joined on its non-null columns under the
declared match semantics (as for SQL foreign keys):

* ``simple``: a reference with any null column is not checked;
* ``partial``: the non-null columns must occur together in some target row;
* ``full``: all null is not checked, some null is an orphan of kind ``malformed``, none null is checked;
* ``each`` (``orphan_fields``): every non-null column is a reference of its own, to a table of its own.

A reference whose target exists may still be an orphan: ``deleted`` if every target row has a deletion time, ``late`` if the
earliest arrival among rows without one is after the reference's own time. Target rows are reduced to one row per key
before they are joined; keys that hold a large share of the references are split off (``skew.join_split``).
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.operators.skew import join_split
from loomlake.session import written


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], at: str, arrived: str, deleted: str, match: str = "simple", always: tuple[str, ...] = ()) -> DataFrame:
    """Rows of refs that are orphans, with ``kind``.

    keys: key columns, of the same names in both tables. always: those of them that are never null (a tag of the reference,
    for instance), which spares their masks. at, arrived, deleted: the reference's time, the target's arrival and deletion.
    Null in ``at`` or ``arrived`` is never late. Empty targets: every checked reference is ``missing``. Repeated references
    stay repeated. Other columns of refs are kept; those of targets never reach the result.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    free = [k for k in keys if k not in always]
    kept = [c for c in refs.columns if c != "kind"]
    # Names of our own throughout, the caller's row in one struct: no column of theirs can clash with ours.
    refs = refs.select(F.struct(*kept).alias("_row"), *keys, F.col(at).alias("_at"))
    side = targets.select(*keys, F.col(arrived).alias("_arrived"), F.col(deleted).alias("_deleted"))
    found = []
    for mask in product((False, True), repeat=len(free)):
        here = reduce(lambda a, b: a & b, [F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(free, mask)], F.lit(True))
        group = refs.filter(here)
        if any(mask):
            if match == "simple" or all(mask):
                continue
            if match == "full":
                found.append(group.select("_row.*", F.lit("malformed").alias("kind")))
                continue
        on = [k for k in keys if k in always or not mask[free.index(k)]]
        live = F.col("_deleted").isNull()
        summary = (
            side.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.lit(True)))
            .groupBy(*on)
            .agg(F.max(live).alias("_live"), F.min(F.when(live, F.col("_arrived"))).alias("_first"))
        )
        joined = join_split(group, summary, on)
        kind: Column = F.when(F.col("_live").isNull(), "missing").when(~F.col("_live"), "deleted").when(F.col("_first") > F.col("_at"), "late")
        found.append(joined.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("_row.*", "kind"))
    return reduce(DataFrame.unionByName, found)


def orphan_fields(refs: DataFrame, targets: dict[str, DataFrame], at: str, arrived: str = "arrived", deleted: str = "deleted") -> DataFrame:
    """Match semantics ``each``: (columns of refs but the keys, fld, kind), one row per orphan column of a reference.

    targets: for each key column of refs its target table (key, arrived, deleted). A row's null mask says which columns it refers by;
    rows of a mask go to the anti-joins of its non-null columns, tagged by the column, so one join serves all masks and a table is
    read once however many columns it has. Kinds, nulls and empty tables as for ``orphan_references``; all null gives no row.
    """
    kept = [c for c in refs.columns if c not in targets and c not in ("fld", "kind")]
    names = sorted(targets)
    mask = sum(F.when(F.col(n).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names))
    rows = refs.select(F.struct(*kept).alias("_row"), F.col(at).alias("_at"), *names, mask.alias("_mask")).filter("_mask > 0")
    present = [F.when(F.col("_mask").bitwiseAND(1 << k) > 0, F.struct(F.lit(n).alias("_fld"), F.col(n).alias("_key"))) for k, n in enumerate(names)]
    rows = written(rows.select("_row", "_at", F.inline(F.array_compact(F.array(*present)))), "orphans-references")
    live = F.col("_deleted").isNull()
    side = reduce(DataFrame.unionByName, [targets[n].select(F.lit(n).alias("_fld"), F.col("key").alias("_key"), F.col(arrived).alias("_arrived"), F.col(deleted).alias("_deleted")) for n in names])
    summary = side.filter("_key is not null").groupBy("_fld", "_key").agg(F.max(live).alias("_live"), F.min(F.when(live, F.col("_arrived"))).alias("_first"))
    kind: Column = F.when(F.col("_live").isNull(), "missing").when(~F.col("_live"), "deleted").when(F.col("_first") > F.col("_at"), "late")
    return join_split(rows, summary, ["_fld", "_key"]).withColumn("kind", kind).filter("kind is not null").select("_row.*", F.col("_fld").alias("fld"), "kind")


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Orphans counted per table and period."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("orphans"))
