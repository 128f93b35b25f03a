"""The jobs: against SQL over whole tables, by two runs over growing input, repeated, and from the command line."""

import json
import logging
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import cell_profiles, clean_texts
from jobs.queries import QUERIES, SQL
from nubila.functions import core

ROOT = Path(__file__).resolve().parent.parent.parent


def rows_of(rows):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(map(tuple, df.select(*columns).collect()))
    assert got == rows_of(found.fetchall()) and got


def written(spark, target):
    return rows_of(map(tuple, clean_texts.read_output(spark, target).collect()))


def test_lines_of_growing_input(spark, small, tmp_path, caplog):
    """Two runs over input that grows equal one run over all of it; a run without new files writes nothing."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 200")
    source, parts = tmp_path / "source", [docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")]
    at = [str(tmp_path / x) for x in ("lines", "checkpoint")]
    caplog.set_level(logging.INFO, logger="jobs.clean_texts")
    counts = []
    for part in parts:
        part.coalesce(2).write.mode("append").parquet(str(source))
        counts.append(clean_texts.run(spark, str(source), *at))
        counts.append(clean_texts.run(spark, str(source), *at))
    assert [c["texts"] for c in counts] == [parts[0].count(), 0, parts[1].count(), 0] and counts[1]["batches"] == counts[3]["lines"] == 0
    clean_texts.run(spark, str(source), str(tmp_path / "all"), str(tmp_path / "new"))
    assert written(spark, at[0]) == written(spark, str(tmp_path / "all"))
    assert counts[0]["lines"] + counts[2]["lines"] == len(written(spark, at[0]))
    assert any("new texts" in m for m in caplog.messages)


def test_files_of_any_age_are_taken(spark, tmp_path):
    """A later file that is older than those read isn't passed over, and small batches take all files."""
    import os

    frame = lambda i: spark.createDataFrame([(i, f"line {i}\n", "en", "s")], "doc_id long, text string, lang string, source string")
    at, run = str(tmp_path / "source"), lambda: clean_texts.run(spark, str(tmp_path / "source"), str(tmp_path / "lines"), str(tmp_path / "mark"), {"files_per_batch": 1})
    for i in range(3):
        frame(i).coalesce(1).write.mode("append").parquet(at)
    assert run()["batches"] == 3
    seen = set(Path(at).glob("*.parquet"))
    frame(9).coalesce(1).write.mode("append").parquet(at)
    for path in set(Path(at).glob("*.parquet")) - seen:
        os.utime(path, (10**9, 10**9))
    assert run()["texts"] == 1
    assert sorted(r["doc_id"] for r in clean_texts.read_output(spark, str(tmp_path / "lines")).collect()) == [0, 1, 2, 9]


def test_lines_of_odd_texts(spark, tmp_path):
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, "\n", None, "s"), (4, "a|1  2.5\r\nx ### y\rlast", "de", "s"), (4, "a|1  2.5\r\nx ### y\rlast", "de", "s"), (None, "7\n\n", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("value", F.lit("clash")).write.parquet(str(tmp_path / "in"))
    clean_texts.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = rows_of((r["doc_id"], r["line"], r["value"], r["n_fields"], r["n_numbers"], r["first_number"], r["lang"]) for r in clean_texts.read_output(spark, str(tmp_path / "out")).collect())
    four = [(4, 1, "a 1 2.5", 3, 2, 1.0, "de"), (4, 3, "last", 1, 0, None, "de")]
    assert got == rows_of([(3, 1, "", 0, 0, None, None), *four, *four, (None, 1, "7", 1, 1, 7.0, "en"), (None, 2, "", 0, 0, None, "en")])


def test_header_and_rows_come_from_the_config(spark, tmp_path):
    spark.createDataFrame([(1, "head\na\nb\nc", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    clean_texts.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), {"header_lines": 1, "rows": [1, 2], "good": ["a", "c"], "replace_text": [[["a"], "z"]]})
    assert [(r["line"], r["value"]) for r in clean_texts.read_output(spark, str(tmp_path / "out")).collect()] == [(1, "z")]


def test_conditions_one_by_one(spark, small, tmp_path):
    """Conditions done in two runs equal all done in one; a repeated run overwrites its own partitions only, and settings stay."""
    source, before = f"{small}/embeddings.parquet", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    read = lambda name: rows_of(map(tuple, cell_profiles.read_output(spark, str(tmp_path / name)).collect()))
    left = set(core._WRITTEN)
    done = cell_profiles.run(spark, source, str(tmp_path / "all"))
    assert set(core._WRITTEN) == left  # its checkpoints are deleted
    assert done == {"cell": 80, "condition": 20}
    for conditions in (["control"], ["treated"], ["control"]):
        cell_profiles.run(spark, source, str(tmp_path / "each"), conditions=conditions)
    assert read("each") == read("all") and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert {p.name for p in (tmp_path / "all").iterdir() if p.is_dir()} == {"level=cell", "level=condition"}


def test_profiles_of_odd_tables(spark, tmp_path):
    config = cell_profiles.settings() | {"columns": {c: c for c in ("id", "x", "y", "z", "channel", "cell_id", "condition")}, "trim": {"column": "z", "percent": 0.0}}
    rows = [(1, 0.0, 0.0, 0.0, "C1", 1, "a"), (2, 3.0, 4.0, 0.0, "C1", 1, "a"), (3, 0.0, 0.0, 12.0, "C2", 1, "a"), (4, None, 0.0, 0.0, "C1", 1, "a"), (5, 1.0, 1.0, 1.0, "C2", 2, "a"), (6, 1.0, 1.0, 1.0, "C1", 3, "b")]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, channel string, cell_id long, condition string").withColumn("ring", F.lit("clash"))
    df.write.parquet(str(tmp_path / "in"))
    assert cell_profiles.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config) == {"cell": 20, "condition": 20}
    got = {(r["cell_id"], r["ring"]): (r["own"], r["other"], r["ratio"], r["near"], r["points"]) for r in cell_profiles.read_output(spark, str(tmp_path / "out")).where("level = 'cell'").collect()}
    assert got[1, 1] == (1.0, 0.0, None, 5.0, 3) and got[1, 2] == (1.0, 1.0, 1.0, 5.0, 3) and got[3, 10] == (0.0, 0.0, None, None, 1)
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert cell_profiles.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"), config) == {}


@pytest.mark.parametrize("module, source, more", [("clean_texts", "documents", ["--checkpoint", "mark"]), ("cell_profiles", "embeddings", ["--conditions", "treated"])])
def test_command_lines(spark, tiny, tmp_path, module, source, more):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(json.loads((ROOT / "jobs" / f"{module}.json").read_text())))
    more = [str(tmp_path / x) if x == "mark" else x for x in more]
    command = [sys.executable, "-m", f"jobs.{module}", "--source", f"{tiny}/{source}.parquet", "--target", str(tmp_path / "out"), "--config", str(config), *more]
    ran = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert ran.returncode == 0 and f"jobs.{module}" in ran.stderr, ran.stderr[-2000:]
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
