"""Raw texts to a clean, numbered line table, taking only files that are new.

Each row of the source table holds one text as an instrument or a crawl left it: header lines, marker lines, odd delimiters. A
file stream reads the files of the source that it hasn't read before, cuts each text into numbered lines, lets the delimited-text
reader's filters and replacements clean them, counts fields and numbers of each line, and appends the lines as Parquet by language.

The stream's checkpoint says what has been read, and the sink's log which files are whole, so a run that fails or is repeated
neither loses nor doubles a line. Files are told apart by path: to change one, write it under another name.

    python -m jobs.clean_texts --source DOCUMENTS --target LINES --checkpoint CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.sources import text as reader

log = logging.getLogger("jobs.clean_texts")

CONFIG = Path(__file__).with_suffix(".json")
SCHEMA = "doc_id long, source string, line long, value string, n_fields long, n_numbers long, first_number double, lang string"
LINE_END = r"\r\n|\r|\n"
NUMBER = r"^[+-]?[0-9]+([.][0-9]+)?$"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def text_lines(texts: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each line of each text: the columns, line (from 1) and value. Null and empty texts have no lines."""
    whole = texts.where(F.col("text") != "").withColumn("__lines", F.split(F.regexp_replace("text", rf"({LINE_END})\z", ""), LINE_END, -1))
    return whole.select(*columns, F.posexplode("__lines").alias("__at", "value")).select(*columns, (F.col("__at") + 1).cast("long").alias("line"), "value")


def measured(lines: DataFrame) -> DataFrame:
    """Fields of each line, parted by spaces; how many are numbers, and the first of those."""
    fields = F.filter(F.split("value", " ", -1), lambda f: f != "")
    numbers = lambda c: F.filter(c, lambda f: f.rlike(NUMBER))
    out = lines.withColumn("__fields", fields)
    first: Column = F.get(numbers(F.col("__fields")), F.lit(0)).cast("double")
    return out.withColumns({"n_fields": F.size("__fields").cast("long"), "n_numbers": F.size(numbers(F.col("__fields"))).cast("long"), "first_number": first}).drop("__fields")


def cleaned(texts: DataFrame, config: dict) -> DataFrame:
    """The lines to write, in the columns of SCHEMA."""
    keys = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kept = reader.clean_lines(
        text_lines(keys, ["doc_id", "source", "lang"]),
        replace_regex=[tuple(r) for r in config.get("replace_regex", [])], replace_text=[tuple(r) for r in config.get("replace_text", [])], replace_chars=config.get("replace_chars", []),
        bad=config.get("bad", []), good=config.get("good", []), rows=tuple(config["rows"]) if config.get("rows") else None, header_lines=config.get("header_lines", 0),
    )
    return measured(kept).select("doc_id", "source", "line", "value", "n_fields", "n_numbers", "first_number", "lang")


def pattern(path: str) -> str:
    """A pattern that matches the path alone: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Appends the clean lines of the source's new files to the target; batches, texts read and lines written in this run.

    source: a folder of Parquet files, one such file, or a pattern.
    """
    config = settings() if config is None else config
    schema = spark.read.parquet(source).schema
    # The first run takes all files and later ones all new files, however old.
    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.get("files_per_batch", 1000)).option("maxFileAge", "36500d").parquet(pattern(source))
    lines = cleaned(texts.observe("texts", F.count("*").alias("n")), config).observe("lines", F.count("*").alias("n"))
    query = lines.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("lang").trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"batches": 0, "texts": 0, "lines": 0}
    for progress in query.recentProgress:
        seen = {k: v["n"] or 0 for k, v in progress.observedMetrics.items()}
        done = {"batches": done["batches"] + bool(progress.numInputRows), "texts": done["texts"] + seen.get("texts", 0), "lines": done["lines"] + seen.get("lines", 0)}
    log.info("read %(texts)d new texts in %(batches)d batches, wrote %(lines)d lines", done)
    log.info("from %s to %s", source, target)
    return done


def read_output(spark: SparkSession, target: str) -> DataFrame:
    """All lines written so far."""
    return spark.read.schema(SCHEMA).parquet(target)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "target", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("clean_texts").getOrCreate()
    try:
        run(spark, given.source, given.target, given.checkpoint, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
