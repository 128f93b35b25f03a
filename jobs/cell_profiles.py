"""Contact profiles of every cell and their roll-up over cells, from a localization table.

For each cell the extremes of one axis are trimmed by quantiles; then the contact ratio of the two channels (own-channel over
other-channel neighbours, for each radius), the mean distance to the nearest own-channel neighbours and the number and mean size of
the own channel's density clusters are taken, and the profiles of a condition's cells are rolled up to mean and number. Rows of both kinds are written as Parquet by level and condition.

A run overwrites the partitions that it has rows for and leaves the others, so repeating one changes nothing, and conditions can be
done one by one (--conditions).

    python -m jobs.cell_profiles --source EMBEDDINGS --target PROFILES [--config FILE] [--conditions A B]
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.functions.core import checkpointed, checkpoints_dropped
from nubila.operators import cluster, filters, profiles, spatial

log = logging.getLogger("jobs.cell_profiles")

CONFIG = Path(__file__).with_suffix(".json")
SCHEMA = "cell_id long, ring int, r double, own double, other double, ratio double, near double, points long, clusters long, size double, cells long, level string, condition string"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def localizations(table: DataFrame, config: dict, conditions: Sequence[str] | None = None) -> DataFrame:
    """id, x, y, z, channel, cell_id and condition by the config's expressions; rows without one of them are left out."""
    kinds = {"id": "long", "x": "double", "y": "double", "z": "double", "channel": "string", "cell_id": "long", "condition": "string"}
    points = table.select(*[F.expr(config["columns"][c]).cast(t).alias(c) for c, t in kinds.items()]).dropna()
    return points.where(F.col("condition").isin(list(conditions))) if conditions else points


def cell_profiles(points: DataFrame, config: dict) -> DataFrame:
    """Rows of level "cell": contact ratio for each radius, nearest-neighbour distance, points and clusters of each cell."""
    keys, (first, second) = ["condition", "cell_id"], config["channels"]
    # Every step below reads the kept points.
    kept = checkpointed(filters.filter_quantile(points, config["trim"]["column"], config["trim"]["percent"], keys).where(F.col("channel").isin(first, second)))
    own, other = kept.where(F.col("channel") == first), kept.where(F.col("channel") == second)
    ratio = profiles.contact_ratio(own, other, config["radius"], config["step"], keys)
    # The nearest of all is the point itself.
    near = spatial.mean_nearest(own, own, config["neighbours"] + 1, config["reach"], keys=keys, skip=1).groupBy(*keys).agg(F.avg("distance").alias("near"))
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("points"))
    clustered = cluster.dbscan(own, config["eps"], config["min_samples"], keys=keys)
    groups = cluster.cluster_sizes(clustered, [*keys, "cluster_label"]).where("cluster_label <> -1").groupBy(*keys).agg(F.count("*").alias("clusters"), F.avg("bb_2D").alias("size"))
    rows = ratio.join(sizes, keys).join(near, keys, "left").join(groups, keys, "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
    return rows.select("cell_id", F.col("ring").cast("int").alias("ring"), "r", "own", "other", "ratio", "near", "points", "clusters", "size", F.lit(1).cast("long").alias("cells"), F.lit("cell").alias("level"), "condition")


def rolled_up(cells: DataFrame) -> DataFrame:
    """Rows of level "condition": means over the condition's cells, and how many have a ratio, for each radius."""
    mean = profiles.replicate_mean(cells, "ratio", ["condition"]).select("condition", "ring", F.col("mean").alias("ratio"), "cells")
    rest = cells.groupBy("condition", "ring").agg(F.first("r").alias("r"), F.avg("own").alias("own"), F.avg("other").alias("other"), F.avg("near").alias("near"), F.sum("points").alias("points"), F.sum("clusters").alias("clusters"), F.avg("size").alias("size"))
    rows = rest.join(mean, ["condition", "ring"])
    return rows.select(F.lit(None).cast("long").alias("cell_id"), "ring", "r", "own", "other", "ratio", "near", "points", "clusters", "size", "cells", F.lit("condition").alias("level"), "condition")


def run(spark: SparkSession, source: str, target: str, config: dict | None = None, conditions: Sequence[str] | None = None) -> dict[str, int]:
    """Writes the profiles of all conditions, or of those named; rows of each level written."""
    config = settings() if config is None else config
    points = localizations(spark.read.parquet(source), config, conditions)
    counted = points.groupBy("condition").agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("cells"))
    for r in counted.orderBy("condition").limit(config.get("log_conditions", 100)).collect():
        log.info("read %d localizations of %d cells of %s from %s", r["n"], r["cells"], r["condition"], source)

    def write(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "condition").parquet(target, compression="zstd")

    with checkpoints_dropped(spark):
        write(cell_profiles(points, config))
    # The roll-up reads what has been written instead of computing it again.
    cells = read_output(spark, target).where("level = 'cell'")
    write(rolled_up(cells.where(F.col("condition").isin(list(conditions))) if conditions else cells))
    done = {r["level"]: r["count"] for r in read_output(spark, target).groupBy("level").count().collect()}
    log.info("%s now holds %s rows", target, done)
    return done


def read_output(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(target)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "target"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--conditions", nargs="*")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("cell_profiles").getOrCreate()
    try:
        run(spark, given.source, given.target, settings(given.config), given.conditions)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
