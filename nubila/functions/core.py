"""Column functions shared by the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(key: Column | str, seed: int | str) -> Column:
    """A number in [0, 1) that depends on key and seed alone, not on partitions: the first 32 bits of an md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def squared_distance(a: str, b: str, axes: Sequence[str]) -> Column:
    """Squared distance of columns a_<axis> and b_<axis>."""
    out = F.lit(0.0)
    for axis in axes:
        d = F.col(f"{a}_{axis}") - F.col(f"{b}_{axis}")
        out = out + d * d
    return out


def grid_index(value: Column, low: Column, size: float, cells: Column) -> Column:
    """Cell of a value in equal cells from low; the last cell is closed, values beyond are clipped."""
    return F.least(F.greatest(F.floor((value - low) / size), F.lit(0)), cells - 1).cast("int")


def voxel_index(value: Column, low: Column, size: float, offset: float = 0.01) -> Column:
    """One-based cell of a value with a small offset."""
    return (F.floor((value + offset - low) / size) + 1).cast("int")


def steps_array(steps: Sequence[Sequence[int]], names: Sequence[str]) -> Column:
    """An array of structs of whole numbers, as one parsed expression."""
    rows = ", ".join("named_struct(" + ", ".join(f"'{n}', {int(v)}" for n, v in zip(names, step, strict=True)) + ")" for step in steps)
    return F.expr(f"array({rows})")


def sphere_volume(r: Column, unit: float = 32.0) -> Column:
    """Volume of a sphere of radius r in a unit of length."""
    return F.lit(4 / 3 * math.pi) * F.pow(r / unit, 3)


def interpolated(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear value at x between two knots; at a knot its own value."""
    return F.when(x == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Where it is unset, a temporary folder of this machine is set and used if all tasks run on it too; on a cluster that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="nubila-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Checkpoints that this driver has written.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def checkpoints_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the checkpoints written inside it; for work whose results are written by then, on one thread.

    Tables that read from these checkpoints can't be read afterwards. Checkpoints of other work stay.
    """
    begin = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > begin:
            place = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written as Parquet to the folder that all executors share, and read back.

    checkpoint() keeps the constraints of the plan it cuts, and in a loop they grow exponentially with its rounds.
    """
    path = new_path(df.sparkSession, "checkpoint")
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """df with each row's place from 1 in the whole table's order; no task sees more than its range of rows.

    Rows are dealt into ranges of the order and checkpointed, so ranges stay as they are; a rank is the place inside its range and
    the rows of the ranges before, of which there is one number each. `order` must end with a unique column.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    # One row for each range.
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn(rank, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


#: A key with more than this share of the rows is hot, unless it has no more than HOT_LEAST of them.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def hot_rows(counts: DataFrame, n: str = "n") -> DataFrame | None:
    """The rows of counts whose n is more than a HOT_SHARE-th of the sum of n, so fewer than HOT_SHARE; None if there are none."""
    total = counts.agg(F.sum(n).alias("n"), F.max(n).alias("most")).first()
    if not total["n"] or total["most"] <= max(HOT_LEAST, total["n"] // HOT_SHARE):
        return None
    return counts.where(F.col(n) > max(HOT_LEAST, total["n"] // HOT_SHARE))


def looked_up(rows: DataFrame, on: Sequence[str], facts: DataFrame, hot: DataFrame | None, spread: Sequence[str]) -> DataFrame:
    """rows left-joined with facts, which has one row for each key; rows without facts get nulls.

    The facts of hot keys (hot: from hot_rows, with the columns of `on`) are broadcast, and their rows are dealt by the columns in
    `spread` in the shuffled join, where they meet nothing; so no task holds a hot key's rows.
    """
    if hot is None:
        return rows.join(facts, list(on), "left")
    more = [c for c in facts.columns if c not in on]
    known = facts.join(F.broadcast(hot.select(*on)), list(on), "left_semi").select(*on, *[F.col(c).alias(f"__hot_{c}") for c in more], F.lit(True).alias("__hot"))
    dealt = rows.join(F.broadcast(known), list(on), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0))
    joined = dealt.join(facts.withColumn("__salt", F.lit(0).cast("long")), [*on, "__salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{c}", c).alias(c) for c in more])
