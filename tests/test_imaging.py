"""Camera frames against direct sums."""

from pyspark.sql import functions as F

from nubila.operators import imaging


def test_frames_hold_the_photons(spark):
    rows = [(1, 1000.0, 800.0, 110.0, 120.0, 500.0, 680.0), (1, 500.0, 500.0, 110.0, 110.0, 300.0, 680.0), (2, 700.0, 700.0, 110.0, 110.0, 50.0, 700.0), (2, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, sigma_x double, sigma_y double, intensity double, wavelength double")
    total = lambda d: {r["frame"]: round(r["s"], 6) for r in d.groupBy("frame").agg(F.sum("photons").alias("s")).collect()}
    plain = imaging.camera_frames(df, 20, 30)
    assert total(plain) == {1: 800.0, 2: 50.0}
    spread = imaging.camera_frames(df, 20, 30, spectrum=([-10.0, 0.0, 10.0], [1.0, 2.0, 1.0]), displacement=(0.1, 680.0))
    assert total(spread) == {1: 800.0, 2: 50.0}
    centre = lambda d: d.where("frame = 2").agg((F.sum(F.col("ix") * F.col("photons")) / F.sum("photons")).alias("c")).first()["c"]
    assert abs(centre(spread) - centre(plain) - 2.0) < 1e-3
    assert imaging.camera_frames(df.limit(0), 5, 5).count() == 0
