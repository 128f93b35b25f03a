"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows and bytes of one Arrow batch: texts can be long, and a batch is held outside the heap and again by Python.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Bytes of a row group of stored intermediates: a writing task holds one in memory.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`.

    Where it is unset, a temporary folder of this machine is set and used if all tasks run on it too; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if not root and set_already.isDefined():
        root = set_already.get()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="nubila-")
    if not set_already.isDefined():
        context.setCheckpointDir(root)
    return root


#: Paths in the shared folder that this driver gave out.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes the intermediates and archives that operators stored in the shared folder; how many there were.

    For the end of a job, when its results are written: what was read from them can't be read again.
    """
    deleted = 0
    while _GIVEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        deleted += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so its lineage is cut and losing executors costs nothing.

    Row groups are short, and the codec keeps no buffers outside the heap that grow with the largest page.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: the session's limits are lowered to ours where they are higher, and stay so."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: A key that holds more than this share of a join's rows is hot, unless it holds no more than HOT_LEAST rows.
HOT_SHARE, HOT_LEAST = 1000, 1000


def hot_keys(rows: DataFrame, key: str, weight: str | None = None) -> dict:
    """The keys that hold more than a HOT_SHARE-th of all rows (or of the sum of weight), with their rows: always few.

    Rows are counted map-side before they are shuffled. Null is never a hot key.
    """
    count = F.sum(weight) if weight else F.count("*")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(count.alias("__n")).where(F.col("__n") > HOT_LEAST)
    plain = lambda k: bytes(k) if isinstance(k, bytearray) else k
    most = {plain(r[0]): r[1] for r in counts.orderBy(F.desc("__n")).limit(HOT_SHARE).collect()}
    if not most:
        return {}
    total = rows.agg(count).first()[0]
    return {k: n for k, n in most.items() if n * HOT_SHARE > total}


def named(column: str) -> Column:
    """The column of that name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def lookup(rows: DataFrame, key: str, facts: DataFrame, hot: dict, spread: Sequence[str]) -> DataFrame:
    """rows left-joined with facts, which has the column `key` and one row for each key; rows without facts get nulls.

    The facts of hot keys (fewer than HOT_SHARE rows) are broadcast. Hot and null keys meet nothing in the shuffled join, where
    the columns in `spread` deal their rows over all tasks, so no task holds a hot key's rows.
    """
    own, more = [named(c) for c in rows.columns], [c for c in facts.columns if c != key]
    names = [f"__cold_{c}" for c in more]
    cold = facts.select(F.col(key).alias("__lookup_key"), F.lit(0).alias("__lookup_at"), *[F.col(c).alias(n) for c, n in zip(more, names, strict=True)])
    idle = F.col(key).isNull()
    if hot:
        keys = rows.sparkSession.createDataFrame([(k,) for k in hot], StructType([StructField("__lookup_k", facts.schema[key].dataType)]))
        known = facts.select(F.col(key).alias("__lookup_hot_key"), *[F.col(c).alias(f"__hot_{c}") for c in more])
        known = known.join(F.broadcast(keys), F.col("__lookup_hot_key") == F.col("__lookup_k"), "left_semi")
        rows = rows.join(F.broadcast(known), F.col(key) == F.col("__lookup_hot_key"), "left")
        idle = idle | F.col("__lookup_hot_key").isNotNull()
    dealt = rows.withColumn("__lookup_salt", F.when(idle, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0))
    joined = dealt.join(cold, (F.col(key) == F.col("__lookup_key")) & (F.col("__lookup_salt") == F.col("__lookup_at")), "left")
    values = [(F.coalesce(f"__hot_{c}", n) if hot else F.col(n)).alias(c) for c, n in zip(more, names, strict=True)]
    return joined.select(*own, *values)


def spread_join(rows: DataFrame, key: str, heavy: DataFrame, hot: dict, spread: Sequence[str]) -> DataFrame:
    """rows joined with heavy, which has the column `key` and one large row for each key.

    The rows of a hot key are dealt by the columns in `spread` into blocks of HOT_LEAST, at most HOT_SHARE of them, and its large
    row is sent once for each block, so no task holds a hot key's rows.
    """
    if not hot:
        return rows.join(heavy, key)
    blocks = [(k, min(HOT_SHARE, -(-n // HOT_LEAST))) for k, n in hot.items()]
    known = rows.sparkSession.createDataFrame(blocks, StructType([StructField("__lookup_k", heavy.schema[key].dataType), StructField("__lookup_blocks", IntegerType())]))

    def counted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(known), F.col(key) == F.col("__lookup_k"), "left").withColumn("__lookup_blocks", F.coalesce("__lookup_blocks", F.lit(1))).drop("__lookup_k")

    dealt = counted(rows).withColumn("__lookup_block", F.pmod(F.xxhash64(*spread), F.col("__lookup_blocks")).cast("int")).drop("__lookup_blocks")
    copies = counted(heavy).withColumn("__lookup_block", F.explode(F.sequence(F.lit(0), F.col("__lookup_blocks") - 1))).drop("__lookup_blocks")
    return dealt.join(copies, [key, "__lookup_block"]).drop("__lookup_block")


def cached(key: tuple, make):
    """One value for each Python worker, kept across its tasks."""
    store = sys.__dict__.setdefault("_nubila_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` over short batches."""
    short_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def filter_arrow(df: DataFrame, column: str, keep) -> DataFrame:
    """The rows of df for which keep(values of the column) is true, over short batches; columns can have any names."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    at, plain = df.columns.index(column), df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return map_arrow(plain, chosen, plain.schema).toDF(*df.columns)
