"""The jobs as registered queries: each runs twice over whole tables into one new folder; its output is then read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cell_profiles, clean_texts
from nubila.functions.core import new_path

CLEAN_TEXTS = r"""
WITH t AS (SELECT doc_id, source, lang, string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS v FROM documents WHERE text <> ''),
l AS (SELECT doc_id, source, lang, unnest(v) AS raw, generate_subscripts(v, 1) AS line FROM t),
c AS (SELECT *, translate(regexp_replace(raw, '[ \t]+', ' ', 'g'), '|', ' ') AS value FROM l WHERE NOT (contains(raw, '$$$') OR contains(raw, '%%%') OR contains(raw, '###') OR contains(raw, '&&&') OR contains(raw, '***'))),
f AS (SELECT *, list_filter(string_split(value, ' '), lambda x: x <> '') AS fields FROM c),
n AS (SELECT *, list_filter(fields, lambda x: regexp_full_match(x, '[+-]?[0-9]+([.][0-9]+)?')) AS numbers FROM f)
SELECT doc_id, source, line::BIGINT AS line, value, len(fields)::BIGINT AS n_fields, len(numbers)::BIGINT AS n_numbers, numbers[1]::DOUBLE AS first_number, lang FROM n
"""

CELL_PROFILES = """
WITH RECURSIVE p AS (SELECT vec_id AS id, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y, 1000 * CAST(embedding[3] AS DOUBLE) AS z, CASE WHEN label % 2 = 0 THEN 'C1' ELSE 'C2' END AS channel, vec_id % 8 AS cell_id, CASE WHEN vec_id % 8 < 4 THEN 'control' ELSE 'treated' END AS condition FROM embeddings),
q AS (SELECT cell_id, quantile_cont(z, 0.05) AS low, quantile_cont(z, 0.95) AS high FROM p GROUP BY cell_id),
k AS (SELECT p.* FROM p JOIN q ON p.cell_id = q.cell_id AND p.z >= q.low AND p.z <= q.high),
d AS (SELECT a.cell_id, a.id, b.id AS other, b.channel, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) AS box FROM k a JOIN k b ON a.cell_id = b.cell_id AND a.channel = 'C1'),
e AS (SELECT cell_id, channel, least(greatest(ceil(sqrt(d2) / 10), 1), 10) AS shell FROM d WHERE d2 <= 10000 AND (channel = 'C2' OR id <> other)),
r AS (SELECT unnest(range(1, 11)) AS ring),
n AS (SELECT cell_id, condition, count(*) AS points, count(*) FILTER (WHERE channel = 'C1') AS own_points FROM k GROUP BY cell_id, condition HAVING own_points > 0),
v AS (SELECT n.cell_id, n.condition, n.points, r.ring, count(e.shell) FILTER (WHERE e.channel = 'C1')::DOUBLE / any_value(own_points) AS own, count(e.shell) FILTER (WHERE e.channel = 'C2')::DOUBLE / any_value(own_points) AS other FROM n CROSS JOIN r LEFT JOIN e ON e.cell_id = n.cell_id AND e.shell <= r.ring GROUP BY ALL),
s AS (SELECT cell_id, id, sqrt(d2) AS distance, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS place FROM d WHERE channel = 'C1' AND box <= 1000),
m AS (SELECT cell_id, avg(mean) AS near FROM (SELECT cell_id, id, avg(distance) AS mean FROM s WHERE place BETWEEN 2 AND 4 GROUP BY cell_id, id) GROUP BY cell_id),
nb AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.cell_id = b.cell_id AND a.channel = 'C1' AND b.channel = 'C1' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 4), ce AS (SELECT nb.a, nb.b FROM nb JOIN core ON nb.b = core.id), cc AS (SELECT ce.a, ce.b FROM ce JOIN core ON ce.a = core.id),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT cc.b, reach.root FROM reach JOIN cc ON cc.a = reach.id), comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
member AS (SELECT ce.a AS id, min(comp.root) AS root FROM ce JOIN comp ON ce.b = comp.id GROUP BY ce.a),
box2 AS (SELECT k.cell_id, root, (max(x) - min(x) + max(y) - min(y)) / 2 AS size FROM member JOIN k ON k.id = member.id GROUP BY k.cell_id, root),
g AS (SELECT cell_id, count(*) AS clusters, avg(size) AS size FROM box2 GROUP BY cell_id),
c AS (SELECT v.cell_id, ring, ring * 10.0::DOUBLE AS r, own, other, own / nullif(other, 0) AS ratio, near, points, coalesce(clusters, 0) AS clusters, size, 1 AS cells, 'cell' AS level, condition FROM v LEFT JOIN m ON v.cell_id = m.cell_id LEFT JOIN g ON v.cell_id = g.cell_id),
u AS (SELECT * FROM c UNION ALL SELECT NULL, ring, any_value(r), avg(own), avg(other), avg(ratio), avg(near), sum(points), sum(clusters), avg(size), count(ratio), 'condition', condition FROM c GROUP BY condition, ring)
SELECT cell_id::BIGINT AS cell_id, ring::BIGINT AS ring, r, round(own, 6) AS own, round(other, 6) AS other, round(ratio, 6) AS ratio, round(near, 6) AS near, points::BIGINT AS points, clusters::BIGINT AS clusters, round(size, 6) AS size, cells::BIGINT AS cells, level, condition FROM u
"""


def job1_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "job1")
    for _ in range(2):
        clean_texts.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/lines", f"{folder}/checkpoint")
    return clean_texts.read_output(spark, f"{folder}/lines")


def job2_cell_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "job2")
    for _ in range(2):
        cell_profiles.run(spark, f"{sf_dir}/embeddings.parquet", f"{folder}/profiles")
    out = cell_profiles.read_output(spark, f"{folder}/profiles")
    return out.withColumns({c: F.round(c, 6) for c in ("own", "other", "ratio", "near", "size")}).withColumn("ring", F.col("ring").cast("long"))


QUERIES = {f.__name__: f for f in (job1_clean_texts, job2_cell_profiles)}
SQL = {"job1_clean_texts": CLEAN_TEXTS, "job2_cell_profiles": CELL_PROFILES}
