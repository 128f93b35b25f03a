"""Row filters and channel assignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nubila.functions.core import ranked, uniform
from nubila.functions.quantiles import exact_quantiles


def _against(df: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df beside one row of bounds, or beside its group's row."""
    return df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))


def filter_quantile(df: DataFrame, column: str, percent: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with column between its interpolated quantiles percent and 1 - percent, both included; nulls and NaN are dropped."""
    bounds = exact_quantiles(df, column, (percent, 1 - percent), keys).withColumnRenamed("q", "__q")
    return _against(df, bounds, keys).where((F.col(column) >= F.col("__q")[0]) & (F.col(column) <= F.col("__q")[1])).drop("__q")


def filter_axial(df: DataFrame, padding: float = 1.0, column: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    """Rows strictly inside the axis range shrunk by padding at both ends."""
    bounds = df.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return _against(df, bounds, keys).where((F.col(column) > F.col("__lo") + padding) & (F.col(column) < F.col("__hi") - padding)).drop("__lo", "__hi")


def split_at_wavelength(df: DataFrame, column: str = "wavelength", cut: float = 680.0, below: str = "me3", above: str = "ac") -> DataFrame:
    """Adds channel by side of the cut; rows exactly at the cut are dropped."""
    return df.withColumn("channel", F.when(F.col(column) < cut, below).when(F.col(column) > cut, above)).where(F.col("channel").isNotNull())


def split_by_windows(df: DataFrame, windows: dict[str, tuple[float, float]], column: str = "wavelength") -> DataFrame:
    """Adds channel by open spectral window; rows in none are dropped."""
    channel = F.lit(None).cast("string")
    for name, (lo, hi) in windows.items():
        channel = F.when((F.col(column) > lo) & (F.col(column) < hi), name).otherwise(channel)
    return df.withColumn("channel", channel).where(F.col("channel").isNotNull())


def split_by_value(df: DataFrame, values: dict[str, float], column: str) -> DataFrame:
    """Adds channel by exact value; other rows are dropped."""
    channel = F.lit(None).cast("string")
    for name, value in values.items():
        channel = F.when(F.col(column) == value, name).otherwise(channel)
    return df.withColumn("channel", channel).where(F.col("channel").isNotNull())


def flip_class(df: DataFrame, column: str, probability: float, seed: int, key: str = "id") -> DataFrame:
    """A 0/1 column flipped with a probability, by keyed uniform."""
    return df.withColumn(column, F.when(uniform(key, seed) < probability, 1 - F.col(column)).otherwise(F.col(column)))


def threshold_class(df: DataFrame, column: str, cutoff: float, name: str = "class") -> DataFrame:
    """Adds a 0/1 column: whether the value exceeds the cut-off."""
    return df.withColumn(name, F.when(F.col(column) > cutoff, 1).otherwise(0))


def modal_window(df: DataFrame, column: str = "z", width: float = 10.0, reach: float = 500.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows within reach of the left edge of the fullest bin of a column; of equal bins the lowest."""
    bins = df.groupBy(*keys, F.floor(F.col(column) / width).alias("__bin")).agg(F.count("*").alias("__n"))
    mode = bins.groupBy(*keys).agg(F.max_by("__bin", F.struct("__n", -F.col("__bin"))).alias("__mode"))
    edge = F.col("__mode") * width
    return _against(df, mode, keys).where(F.col(column).between(edge - reach, edge + reach)).drop("__mode")


def trim_low_density(df: DataFrame, column: str, share: float = 0.05, keys: Sequence[str] = (), order: str = "id") -> DataFrame:
    """Drops the round(share n) + 1 largest values of a mean-distance column, and zeros."""
    if keys:
        w = Window.partitionBy(*keys)
        placed = df.withColumn("__rank", F.row_number().over(w.orderBy(column, order))).withColumn("__n", F.count("*").over(w))
    else:
        placed = ranked(df, column, order, rank="__rank")
        placed = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("__n"))))
    return placed.where((F.col("__rank") <= F.col("__n") - F.round(share * F.col("__n")) - 1) & (F.col(column) > 0)).drop("__rank", "__n")


def in_mask(df: DataFrame, mask: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = ("ix", "iy")) -> DataFrame:
    """Rows whose raster cell is in the mask."""
    return df.join(mask.select(*keys, *columns), [*keys, *columns], "left_semi")


def scale_and_centre(df: DataFrame, scales: dict[str, float], centre: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Scaled coordinates; those named in centre are shifted to mean zero."""
    out = df.withColumns({c: F.col(c) * k for c, k in scales.items()})
    if not centre:
        return out
    means = out.groupBy(*keys).agg(*[F.avg(c).alias(f"__{c}") for c in centre])
    return _against(out, means, keys).withColumns({c: F.col(c) - F.col(f"__{c}") for c in centre}).drop(*[f"__{c}" for c in centre])


def drop_unstable_start(df: DataFrame, column: str, keys: Sequence[str], ring: str = "ring", limit: float = 1e6) -> DataFrame:
    """Drops a profile's first entry if it exceeds the limit, and numbers the rest from 1."""
    w = Window.partitionBy(*keys).orderBy(ring)
    return df.where(~((F.col(ring) == 1) & (F.col(column) > limit))).withColumn(ring, F.row_number().over(w))


def wavelength_of(displacement: Column, p1: float, p2: float, p3: float) -> Column:
    """Spectral calibration: a quadratic of the displacement."""
    return p1 * displacement * displacement + p2 * displacement + p3


def displacement_of(wavelength: Column, p1: float, p2: float, p3: float) -> Column:
    """The positive root of the calibration."""
    return (-p2 + F.sqrt(F.lit(p2 * p2) - 4 * p1 * (F.lit(p3) - wavelength))) / (2 * p1)


def cluster_color(label: Column) -> Column:
    """A colour for each label from its hash, opaque; noise is grey."""
    parts = [F.round(uniform(label, f"color{k}"), 6) for k in range(3)]
    return F.when(label == -1, F.array(*[F.lit(x) for x in (0.7, 0.7, 0.7, 0.5)])).otherwise(F.array(*parts, F.lit(1.0)))


def viewer_layers(df: DataFrame, size_scale: float = 1.0, channel: str = "channel") -> DataFrame:
    """Layer name and point size of each localization, for a viewer."""
    kind = F.when(F.col("cluster_label") == -1, "noise").otherwise("clustered")
    return df.withColumn("layer", F.concat_ws("_", channel, kind)).withColumn("plot_size", F.col("sigma_x") / 110 * size_scale)


def where_line(df: DataFrame, predicate: Callable[[Column], Column], line: str = "line") -> DataFrame:
    """Rows whose line number satisfies a predicate."""
    return df.where(predicate(F.col(line)))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Channels or replicates below each other, matched by column name; columns that one lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def plot_limit(df: DataFrame, column: str, share: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """Upper limit of a plot's colours: an interpolated quantile of the values."""
    return exact_quantiles(df, column, (share,), keys).select(*keys, F.col("q")[0].alias("upper"))
