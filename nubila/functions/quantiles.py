"""Exact quantiles by histograms that are refined around the wanted ranks.

Every pass counts the values of each range that still holds a wanted rank in BINS bins, map-side before the shuffle, and keeps the
bin with the rank, drawn in to the values that are in it. A range is done when it holds one value; that takes as many passes as the
values' spread has factors of BINS, two or three in practice, however many rows there are. No task holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import checkpointed

BINS = 4096
#: Values of the largest group that one task may hold; if none has more, one aggregation finds all quantiles.
DIRECT = 1_000_000
#: Rows of ranges that are broadcast at most; more are joined by key.
BROADCAST = 50_000


def _beside(rows: DataFrame, small: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """rows beside the rows of `small` with their keys; small has n rows."""
    if not keys:
        return rows.crossJoin(F.broadcast(small))
    return rows.join(F.broadcast(small) if n <= BROADCAST else small, list(keys))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and q: the interpolated quantiles of a column for each of the shares, as an array.

    Nulls and NaN don't count; groups without values have no row, but without keys there is one, with null for q. A quantile lies
    between the values of the ranks around share * (n - 1).
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    whole = checkpointed(rows.groupBy(*keys).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count("*").alias("n")))
    largest = whole.agg(F.max("n")).first()[0] or 0
    if largest <= DIRECT:
        return rows.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    ranks = [F.least(F.floor(share * (F.col("n") - 1)) + more, F.col("n") - 1).cast("long") for share in shares for more in (0, 1)]
    wanted = whole.where("n > 0").select(*keys, "low", "high", F.lit(0).cast("long").alias("before"), F.posexplode(F.array(*ranks)).alias("i", "rank"))
    done, waiting = None, wanted
    while True:
        waiting = checkpointed(waiting)
        part = waiting.where("low = high").select(*keys, "i", F.col("low").alias("value"))
        done = part if done is None else done.union(part)
        waiting = waiting.where("low < high")
        ranges = waiting.select(*keys, "low", "high").distinct()
        n = ranges.count()
        if not n:
            break
        near = _beside(rows, ranges, keys, n).where(F.col("__v").between(F.col("low"), F.col("high")))
        # Halves are compared, so that ranges of the greatest numbers don't overflow.
        width = F.col("high") / 2 - F.col("low") / 2
        share = F.when(width > 0, (F.col("__v") / 2 - F.col("low") / 2) / width).otherwise((F.col("__v") > F.col("low")).cast("double"))
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        bins = near.groupBy(*keys, "low", "high", place.alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        below = F.sum("n").over(Window.partitionBy(*keys, "low", "high").orderBy("bin")) - F.col("n")
        met = waiting.join(bins.withColumn("below", below), [*keys, "low", "high"])
        first = F.col("before") + F.col("below")
        waiting = met.where((F.col("rank") >= first) & (F.col("rank") < first + F.col("n"))).select(*keys, F.col("least").alias("low"), F.col("most").alias("high"), first.alias("before"), "i", "rank")
    values = done.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v"))
    found = whole.join(values, keys, "left") if keys else whole.crossJoin(F.broadcast(values))

    def between(k: int, share: float):
        at, above = (F.col("v")[2 * k + m]["value"] for m in (0, 1))
        part = share * (F.col("n") - 1) - F.floor(share * (F.col("n") - 1))
        return F.when(at == above, at).otherwise(at * (1 - part) + above * part)

    q = F.array(*[between(k, float(s)) for k, s in enumerate(shares)])
    return found.select(*keys, F.when(F.size("v") > 0, q).alias("q"))
