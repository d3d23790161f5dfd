"""Global order without a single-partition window.

File positions are identities in sequence corpora: ids, ranks and token offsets all
are running sums over one total order. ``running`` computes them with one shuffle of
the rows: they are range-partitioned by the whole composite key (Spark bounds the sample
per input partition), summed inside their bucket while they are written, and bucket totals
(one row per bucket) become offsets. A hot key is split like any other range, because the
bounds compare the whole key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from seqspark.session import scratch_dir

def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def placed(df: DataFrame, order: list, sums: dict[str, Column], group: list[str], buckets: int) -> DataFrame:
    """Rows range-partitioned and sorted by ``group`` and ``order``, with the bucket and, per
    sum, the value (``_v*``) and the running sum inside the bucket and group (``_l*``).

    The table is written to the shared folder: bucket numbers stay what they are when a
    later job reads them or an executor is lost.
    """
    keys = {f"_k{i}": _col(c) for i, c in enumerate([*group, *order])}
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    rows = df.withColumns(keys | values)
    rows = rows.withColumns({v: F.col(v).cast("bigint") for v in values if rows.schema[v].dataType.simpleString() in ("int", "smallint", "tinyint")})
    rows = rows.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("_bucket", F.spark_partition_id())
    kept = [c for c in rows.columns if c not in keys]
    marks = [f"_k{i}" for i in range(len(group))]
    schema = StructType([*[rows.schema[c] for c in kept], *[StructField(f"_l{i}", rows.schema[v].dataType) for i, v in enumerate(values)]])
    target, names = to_arrow_schema(schema), list(values)

    def local(batches):
        last, carry = None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            change = _changes(batch, marks)
            if marks:
                change[0] = [batch.column(m)[0].as_py() for m in marks] != last
                last = [batch.column(m)[batch.num_rows - 1].as_py() for m in marks]
            out = [batch.column(c) for c in kept]
            for i, v in enumerate(names):
                total = _restarted(batch.column(v).fill_null(0).to_numpy(zero_copy_only=False), change, carry[i])
                carry[i] = total[-1]
                out.append(pa.array(total, target.field(f"_l{i}").type))
            yield pa.RecordBatch.from_arrays(out, names=target.names)

    path = scratch_dir(df.sparkSession, "placed")
    rows.mapInArrow(local, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _changes(batch: pa.RecordBatch, marks: list[str]) -> np.ndarray:
    """True where a row's group differs from that of the row before; nulls are one group."""
    change = np.zeros(batch.num_rows, bool)
    for m in marks:
        a, b = batch.column(m).slice(1), batch.column(m).slice(0, batch.num_rows - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        change[1:] |= ~same.to_numpy(zero_copy_only=False)
    return change


def _restarted(values: np.ndarray, change: np.ndarray, carry) -> np.ndarray:
    """Running sums that start again at each change; whole numbers in one pass."""
    starts = np.flatnonzero(change)
    if values.dtype.kind in "iu":
        total = np.cumsum(values)
        before = np.concatenate([[-carry], total[starts] - values[starts]])
        return total - before[np.cumsum(change)]
    ends = [*starts[1:], len(values)] if len(starts) else []
    head = values[: starts[0] if len(starts) else len(values)].copy()
    if len(head):
        head[0] += carry
    return np.concatenate([np.cumsum(head), *[np.cumsum(values[s:e]) for s, e in zip(starts, ends)]])


def running(df: DataFrame, order: list, sums: dict[str, Column], group: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Add inclusive running sums over a total order, optionally restarted per group.

    ``order`` holds columns (negate for descending) that identify a row; ``sums`` maps a
    new column name to the summed expression (null counts as zero). Groups may be of any
    size and skew; null keys come first. The rows are written once while the plan is built.
    """
    group = list(group or [])
    table = placed(df, order, sums, group, buckets or parallelism(df))
    totals = table.groupBy(*group, "_bucket").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    # Without groups these are one row per bucket, whatever the size of the table.
    window = Window.partitionBy(*group).orderBy("_bucket")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.row_number().over(window).alias("_nth"),
        *[F.sum(f"_t{i}").over(before).alias(f"_o{i}") for i in range(len(sums))],
    )
    # Only the first group of a bucket can have begun earlier: one row per bucket at most.
    offsets = offsets.filter("_nth > 1").drop("_nth")
    match = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = table.join(F.broadcast(offsets), match, "left")
    out = {name: F.col(f"_l{i}") + F.coalesce(F.col(f"_o{i}"), F.lit(0)) for i, name in enumerate(sums)}
    return rows.select(*[c for c in df.columns if c not in sums], *[v.alias(n) for n, v in out.items()])


def ranked(df: DataFrame, order: list, out: str = "rank", group: list[str] | None = None, **kw) -> DataFrame:
    """Add a dense 0-based position in the total order."""
    numbered = running(df, order, {out: F.lit(1).cast("bigint")}, group, **kw)
    return numbered.withColumn(out, F.col(out) - 1)
