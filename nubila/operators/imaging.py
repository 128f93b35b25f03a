"""Simulated camera frames: point spread and first-order spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camera_frames(blinks: DataFrame, height: int, width: int, px: float = 100.0, spectrum: tuple[list[float], list[float]] | None = None, displacement: tuple[float, float] | None = None) -> DataFrame:
    """Photons of each pixel and frame: frame, ix, iy, photons (zeros left out).

    blinks: frame, x, y (nm), sigma_x, sigma_y (nm), intensity and, for spectra, wavelength. With a spectrum (offsets in nm from the
    emission maximum, weights) a blink's photons are spread along x, displacement (pixels a nm, wavelength of no displacement)
    saying where each wavelength falls; the weights are scaled to sum 1. A spot sums to its photons inside the frame; one that lies
    wholly outside adds nothing. Null coordinates leave a blink out. Each blink becomes the few pixels it reaches, and pixels are
    summed before they are shuffled, so a frame isn't one group of one task.
    """
    offsets, weights = spectrum or ([0.0], [1.0])
    total = sum(weights)
    slope, zero = displacement or (0.0, 0.0)
    lines = F.array(*[F.struct(F.lit(float(o)).alias("o"), F.lit(float(w) / total).alias("w")) for o, w in zip(offsets, weights, strict=True)])
    rows = blinks.dropna(subset=["x", "y", "sigma_x", "sigma_y", "intensity"]).withColumn("__line", F.explode(lines))
    wave = slope * (F.col("wavelength") + F.col("__line.o") - zero) if spectrum and "wavelength" in blinks.columns else F.lit(0.0)
    rows = rows.select("frame", (F.col("intensity") * F.col("__line.w")).alias("photons"), (F.col("x") / px + F.coalesce(wave, F.lit(0.0))).alias("px"), (F.col("y") / px).alias("py"), (F.col("sigma_x") / px).alias("sx"), (F.col("sigma_y") / px).alias("sy"))

    def axis(middle: str, sigma: str, size: int) -> Column:
        """Place and share of the pixels of one axis that hold more than a 10^-12 of the spot."""
        far = lambda k: (k - F.col(middle)) / F.col(sigma)
        all_of_it = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(k.alias("k"), F.exp(-0.5 * far(k) * far(k)).alias("g")))
        return F.filter(all_of_it, lambda p: p["g"] > 0)

    def shares(values: str) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, p: a + p["g"])

    both = rows.withColumn("xs", axis("px", "sx", width)).withColumn("ys", axis("py", "sy", height))
    both = both.withColumn("tx", shares("xs")).withColumn("ty", shares("ys")).where("tx > 0 and ty > 0")
    kept = lambda v, t: F.filter(v, lambda p: p["g"] > F.col(t) * 1e-12)
    spread = both.withColumn("p", F.explode(kept("xs", "tx"))).withColumn("q", F.explode(kept("ys", "ty")))
    light = F.col("photons") * (F.col("p.g") / F.col("tx")) * (F.col("q.g") / F.col("ty"))
    pixels = spread.groupBy(F.col("frame").cast("int").alias("frame"), F.col("p.k").alias("ix"), F.col("q.k").alias("iy")).agg(F.sum(light).alias("photons"))
    return pixels.where(F.col("photons") > 1e-9)
