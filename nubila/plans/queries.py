"""Registered queries of the operators over the shared tables, each with SQL for the same rows where SQL can say it.

Point clouds are views of `embeddings`: the first three coordinates times 1000, the label's parity as channel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.operators import cluster, filters, fitting, profiles, raster, sampling, spatial
from nubila.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (1000 * F.element_at("embedding", i).cast("double"))
    return e.select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.when(F.col("label") % 2 == 0, "C1").otherwise("C2").alias("channel"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 4).alias("cell_id"))


PTS = "pts AS (SELECT vec_id AS id, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y, 1000 * CAST(embedding[3] AS DOUBLE) AS z, CASE WHEN label % 2 = 0 THEN 'C1' ELSE 'C2' END AS channel, label, vec_id % 4 AS cell_id FROM embeddings)"


def shaped(df: DataFrame, whole: str = "", real: str = "", other: str = "") -> DataFrame:
    """Whole numbers as BIGINT, real ones as DOUBLE rounded to 6 places, others as they are."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in whole.split()], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in real.split()], *other.split())


def channel(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("channel") == name)


# --- filters ---------------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem, b WHERE l_extendedprice >= lo AND l_extendedprice <= hi""")
def filter_quantile(spark, d):
    return filters.filter_quantile(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice"), "l_extendedprice")


@query(f"""WITH {PTS}, b AS (SELECT channel, min(z) AS lo, max(z) AS hi FROM pts GROUP BY channel)
SELECT p.id, p.channel, round(p.z, 6) AS z FROM pts p JOIN b ON p.channel = b.channel WHERE p.z > b.lo + 1 AND p.z < b.hi - 1""")
def filter_axial(spark, d):
    return shaped(filters.filter_axial(points(spark, d), 1.0, "z", ["channel"]), "id", "z", "channel")


def wavelengths(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.lit(640.0) + (F.col("event_id") * 37) % 101).alias("wavelength"))


LIGHT = "w AS (SELECT event_id AS id, 640.0::DOUBLE + (event_id * 37) % 101 AS wavelength FROM events)"


@query(f"WITH {LIGHT} SELECT id, wavelength, CASE WHEN wavelength < 680 THEN 'me3' ELSE 'ac' END AS channel FROM w WHERE wavelength <> 680")
def channel_split(spark, d):
    return filters.split_at_wavelength(wavelengths(spark, d))


@query(f"WITH {LIGHT} SELECT id, wavelength, CASE WHEN wavelength < 688.35 THEN 'me3' ELSE 'ac' END AS channel FROM w WHERE (wavelength > 655.62 AND wavelength < 688.35) OR (wavelength > 704.715 AND wavelength < 737.445)")
def channel_windows(spark, d):
    return filters.split_by_windows(wavelengths(spark, d), {"me3": (655.62, 688.35), "ac": (704.715, 737.445)})


@query(f"WITH {LIGHT} SELECT id, wavelength, CASE WHEN wavelength = 671 THEN 'me3' ELSE 'ac' END AS channel FROM w WHERE wavelength IN (671, 705)")
def channel_values(spark, d):
    return filters.split_by_value(wavelengths(spark, d), {"me3": 671.0, "ac": 705.0}, "wavelength")


U = "(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


@query(f"SELECT event_id AS id, CASE WHEN {U.format(key='event_id::VARCHAR', seed=5)} < 0.3 THEN 1 - event_id % 2 ELSE event_id % 2 END AS class FROM events")
def class_flip(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("class"))
    return filters.flip_class(df, "class", 0.3, 5)


@query(f"""WITH {PTS}, n AS (SELECT floor(z / 10) AS bin, count(*) AS n FROM pts GROUP BY 1), m AS (SELECT bin * 10 AS edge FROM n ORDER BY n DESC, bin LIMIT 1)
SELECT id, round(z, 6) AS z FROM pts, m WHERE z >= edge - 50 AND z <= edge + 50""")
def modal_window(spark, d):
    return shaped(filters.modal_window(points(spark, d), reach=50.0), "id", "z")


@query(f"""WITH {PTS}, s AS (SELECT id, channel, x * 4.9 AS x, z * 4.9 AS z FROM pts), m AS (SELECT channel, avg(z) AS mz FROM s GROUP BY channel)
SELECT s.id, round(s.x, 6) AS x, round(s.z - m.mz, 6) AS z FROM s JOIN m ON s.channel = m.channel""")
def scale_and_centre(spark, d):
    return shaped(filters.scale_and_centre(points(spark, d).select("id", "channel", "x", "z"), {"x": 4.9, "z": 4.9}, ["z"], ["channel"]), "id", "x z")


# --- grids -----------------------------------------------------------------------------------------------------------------

BOX = "box AS (SELECT min(x) AS x0, min(y) AS y0, greatest(ceil((max(x) - min(x)) / 50), 1)::BIGINT AS nx, greatest(ceil((max(y) - min(y)) / 50), 1)::BIGINT AS ny FROM pts)"
GRID = f"{PTS}, {BOX}, og AS (SELECT id, channel, least(greatest(floor((x - x0) / 50), 0), nx - 1)::BIGINT AS ix, least(greatest(floor((y - y0) / 50), 0), ny - 1)::BIGINT AS iy FROM pts, box), grid AS (SELECT ix, iy, count(*) AS value FROM og GROUP BY ix, iy)"
MASK = f"{GRID}, mask AS (SELECT ix, iy FROM grid WHERE value > 2)"
CELLS = "cells AS (SELECT a.i AS ix, b.i AS iy FROM box, (SELECT unnest(range(-1, 201)) AS i) a, (SELECT unnest(range(-1, 201)) AS i) b WHERE a.i <= nx AND b.i <= ny)"


def gridded(spark, d):
    p = points(spark, d)
    box = raster.extent(p, 50.0)
    return p, box, raster.on_grid(p, box, 50.0)


def mask_of(spark, d):
    p, box, on = gridded(spark, d)
    return on, box, raster.threshold(on.groupBy("ix", "iy").agg(F.count("*").alias("value")), 2)


@query(f"WITH {GRID} SELECT ix, iy, value FROM grid")
def density_grid_2d(spark, d):
    return shaped(raster.density_grid(points(spark, d)), "ix iy value")


VOX = f"{PTS}, low AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM pts), v AS (SELECT id, z, (floor((x + 0.01 - x0) / 50) + 1)::BIGINT AS ix, (floor((y + 0.01 - y0) / 50) + 1)::BIGINT AS iy, (floor((z + 0.01 - z0) / 50) + 1)::BIGINT AS iz FROM pts, low)"


@query(f"WITH {VOX} SELECT ix, iy, iz, count(*) AS value FROM v GROUP BY ix, iy, iz")
def voxel_count_3d(spark, d):
    return shaped(raster.voxel_counts(points(spark, d), 50.0), "ix iy iz value")


@query(f"WITH {VOX} SELECT ix, iy, count(*) AS value FROM v GROUP BY ix, iy")
def grid_collapse(spark, d):
    return shaped(raster.collapsed(raster.voxel_counts(points(spark, d), 50.0)), "ix iy value")


@query(f"WITH {VOX}, r AS (SELECT ix, iy, iz, count(*) OVER (PARTITION BY ix, iy, iz) AS n, z / 7 AS ratio, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY id DESC) AS k FROM v) SELECT ix, iy, iz, round(n + ratio, 6) AS value FROM r WHERE k = 1")
def heat_voxels(spark, d):
    return shaped(raster.heat_voxels(points(spark, d).withColumn("ratio", F.col("z") / 7), 50.0), "ix iy iz", "value")


D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def near_sql(name: str, other: str) -> str:
    return f"{name} AS (SELECT id, avg(sqrt(d2)) AS distance FROM (SELECT a.id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS k FROM pts a JOIN pts b ON a.channel = 'C1' AND b.channel = '{other}' AND abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 AND abs(a.z - b.z) <= 200) WHERE k <= 10 GROUP BY id)"


@query(
    f"WITH {PTS}, {near_sql('n', 'C1')}, {near_sql('f', 'C2')}, q AS (SELECT p.id, p.x, p.y, p.z, f.distance / n.distance AS ratio FROM pts p JOIN n ON p.id = n.id AND n.distance > 0 JOIN f ON p.id = f.id), low AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM q), "
    "v AS (SELECT id, ratio, (floor((x + 0.01 - x0) / 50) + 1)::BIGINT AS ix, (floor((y + 0.01 - y0) / 50) + 1)::BIGINT AS iy, (floor((z + 0.01 - z0) / 50) + 1)::BIGINT AS iz FROM q, low) SELECT ix, iy, iz, round(count(*) + max_by(ratio, id), 6) AS value FROM v GROUP BY ix, iy, iz"
)
def density_ratio_voxels(spark, d):
    """Voxels of the first channel, heated by how much nearer its own points are than the other channel's."""
    p = points(spark, d)
    rated = spatial.density_ratio(channel(p, "C1"), channel(p, "C2"), 10, 200.0).where("ratio IS NOT NULL")
    return shaped(raster.heat_voxels(rated, 50.0), "ix iy iz", "value")


@query("SELECT floor(l_quantity / 5)::BIGINT AS ix, floor(l_extendedprice / 5000)::BIGINT AS iy, count(*) AS value FROM lineitem GROUP BY 1, 2")
def density_grid_large(spark, d):
    df = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).alias("ix"), F.floor(F.col("l_extendedprice") / 5000).alias("iy"))
    return shaped(df.groupBy("ix", "iy").agg(F.count("*").alias("value")), "ix iy value")


@query(f"WITH {MASK} SELECT o.id, o.ix, o.iy FROM og o JOIN mask m ON o.ix = m.ix AND o.iy = m.iy")
def mask_semi_join(spark, d):
    on, _, mask = mask_of(spark, d)
    return shaped(filters.in_mask(on, mask), "id ix iy")


@query(f"""WITH {GRID}, k AS (SELECT i, exp(-0.5 * (i / 1.0) * (i / 1.0)) AS w FROM (SELECT unnest(range(-4, 5)) AS i)), kk AS (SELECT i, w / (SELECT sum(w) FROM k) AS w FROM k),
xs AS (SELECT unnest(range(0, 200)) AS i), ax AS (SELECT x.i AS t, kk.w, ((x.i + kk.i) % (2 * nx) + 2 * nx) % (2 * nx) AS m, nx FROM xs x, kk, box WHERE x.i < nx), ay AS (SELECT y.i AS t, kk.w, ((y.i + kk.i) % (2 * ny) + 2 * ny) % (2 * ny) AS m, ny FROM xs y, kk, box WHERE y.i < ny),
fx AS (SELECT t, w, CASE WHEN m < nx THEN m ELSE 2 * nx - 1 - m END AS s FROM ax), fy AS (SELECT t, w, CASE WHEN m < ny THEN m ELSE 2 * ny - 1 - m END AS s FROM ay),
p1 AS (SELECT fx.t AS ix, g.iy, sum(fx.w * g.value) AS value FROM fx JOIN grid g ON fx.s = g.ix GROUP BY 1, 2),
p2 AS (SELECT p1.ix, fy.t AS iy, sum(fy.w * p1.value) AS value FROM fy JOIN p1 ON fy.s = p1.iy GROUP BY 1, 2)
SELECT ix, iy, round(value, 6) AS value FROM p2 WHERE value > 0.001""")
def gauss_smooth(spark, d):
    p, box, _ = gridded(spark, d)
    return shaped(raster.gaussian(raster.density_grid(p, 50.0, box=box), box, 1.0).where("value > 0.001"), "ix iy", "value")


REACH = f"""WITH RECURSIVE {MASK}, reach(ix, iy, rx, ry) AS (SELECT ix, iy, ix, iy FROM mask UNION SELECT m.ix, m.iy, r.rx, r.ry FROM reach r JOIN mask m ON abs(m.ix - r.ix) + abs(m.iy - r.iy) = 1),
part AS (SELECT ix, iy, min(rx * 1000 + ry) AS component FROM reach GROUP BY ix, iy)"""


def parts_of(spark, d):
    on, box, mask = mask_of(spark, d)
    return on, box, mask, raster.components(mask)


@query(f"{REACH} SELECT ix, iy, component FROM part")
def components(spark, d):
    parts = parts_of(spark, d)[3]
    return shaped(parts.select("ix", "iy", (F.col("component.ix") * 1000 + F.col("component.iy")).alias("component")), "ix iy component")


@query(f"{REACH}, n AS (SELECT component, count(*) AS n FROM part GROUP BY component), b AS (SELECT component FROM n ORDER BY n DESC, component LIMIT 1) SELECT ix, iy FROM part JOIN b ON part.component = b.component")
def largest_component(spark, d):
    return shaped(raster.largest(parts_of(spark, d)[3]), "ix iy")


@query(f"{REACH}, n AS (SELECT component, count(*) AS n FROM part GROUP BY component HAVING count(*) >= 3) SELECT ix, iy FROM part JOIN n ON part.component = n.component")
def drop_small_components(spark, d):
    return shaped(raster.drop_small(parts_of(spark, d)[3], 3), "ix iy")


@query(f"""WITH RECURSIVE {PTS}, m AS (SELECT DISTINCT cell_id, floor(x / 60)::BIGINT AS ix, floor(y / 60)::BIGINT AS iy FROM pts), link AS (SELECT a.cell_id, a.ix, a.iy, b.ix AS jx, b.iy AS jy FROM m a JOIN m b ON a.cell_id = b.cell_id AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
reach(cell_id, ix, iy, root) AS (SELECT cell_id, ix, iy, (ix, iy) FROM m UNION SELECT l.cell_id, l.jx, l.jy, r.root FROM reach r JOIN link l ON r.cell_id = l.cell_id AND r.ix = l.ix AND r.iy = l.iy),
c AS (SELECT cell_id, ix, iy, min(root) AS root FROM reach GROUP BY cell_id, ix, iy), k AS (SELECT cell_id, root, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, root) AS k FROM c GROUP BY cell_id, root) SELECT c.cell_id, ix, iy FROM c JOIN k ON c.cell_id = k.cell_id AND c.root = k.root WHERE k <= 2""")
def largest_by_cell(spark, d):
    """The two largest parts of each cell's own mask."""
    mask = points(spark, d).select("cell_id", F.floor(F.col("x") / 60).cast("int").alias("ix"), F.floor(F.col("y") / 60).cast("int").alias("iy")).distinct()
    return shaped(raster.largest(raster.components(mask, keys=["cell_id"]), 2, ["cell_id"]), "cell_id ix iy")


@query(f"""WITH RECURSIVE {MASK}, {CELLS}, free AS (SELECT c.ix, c.iy FROM cells c LEFT JOIN mask m ON c.ix = m.ix AND c.iy = m.iy WHERE m.ix IS NULL),
outside(ix, iy) AS (SELECT ix, iy FROM free WHERE ix = -1 AND iy = -1 UNION SELECT f.ix, f.iy FROM outside o JOIN free f ON abs(f.ix - o.ix) + abs(f.iy - o.iy) = 1)
SELECT c.ix, c.iy FROM cells c LEFT JOIN outside o ON c.ix = o.ix AND c.iy = o.iy WHERE o.ix IS NULL""")
def fill_holes(spark, d):
    _, box, mask = mask_of(spark, d)
    return shaped(raster.fill_holes(mask, box), "ix iy")


DISTANCE = f"{MASK}, {CELLS}, bg AS (SELECT c.ix, c.iy FROM cells c JOIN box ON true LEFT JOIN mask m ON c.ix = m.ix AND c.iy = m.iy WHERE m.ix IS NULL AND c.ix >= 0 AND c.iy >= 0 AND c.ix < nx AND c.iy < ny), dist AS (SELECT m.ix, m.iy, sqrt(min((m.ix - b.ix) * (m.ix - b.ix) + (m.iy - b.iy) * (m.iy - b.iy))) AS distance FROM mask m, bg b GROUP BY m.ix, m.iy)"


@query(f"WITH {DISTANCE} SELECT ix, iy, round(distance, 6) AS distance FROM dist")
def distance_map(spark, d):
    _, box, mask = mask_of(spark, d)
    return shaped(raster.distance_map(mask, box), "ix iy", "distance")


BANDS = f"{DISTANCE}, bands AS (SELECT ix, iy, (10 - least(greatest(floor(distance * 10 / (SELECT max(distance) FROM dist)) + 1, 1), 10))::BIGINT AS band FROM dist)"


@query(f"WITH {BANDS} SELECT ix, iy, band FROM bands")
def radial_bands(spark, d):
    _, box, mask = mask_of(spark, d)
    return shaped(raster.radial_bands(raster.distance_map(mask, box), 10), "ix iy band")


@query(f"WITH {BANDS}, px AS (SELECT band, count(*) AS pixels FROM bands GROUP BY band), pt AS (SELECT b.band, count(*) AS points FROM og o JOIN bands b ON o.ix = b.ix AND o.iy = b.iy GROUP BY b.band) SELECT px.band, coalesce(points, 0) AS points, pixels, round(coalesce(points, 0) / pixels::DOUBLE, 6) AS density FROM px LEFT JOIN pt ON px.band = pt.band")
def band_profile(spark, d):
    on, box, mask = mask_of(spark, d)
    return shaped(raster.band_profile(on, raster.radial_bands(raster.distance_map(mask, box), 10)), "band points pixels", "density")


PEEL = f"{MASK}, {CELLS}, bg AS (SELECT c.ix, c.iy FROM cells c LEFT JOIN mask m ON c.ix = m.ix AND c.iy = m.iy WHERE m.ix IS NULL), rings AS (SELECT m.ix, m.iy, min(abs(m.ix - b.ix) + abs(m.iy - b.iy)) AS ring FROM mask m, bg b GROUP BY m.ix, m.iy)"


@query(f"WITH {PEEL} SELECT ix, iy, ring FROM rings")
def peel_rings(spark, d):
    return shaped(raster.peel(mask_of(spark, d)[2], (*raster.FOUR, (0, 0))), "ix iy ring")


@query(f"WITH {PEEL}, a AS (SELECT ring, count(*) * 0.0025::DOUBLE AS area FROM rings GROUP BY ring), c AS (SELECT r.ring, count(*) FILTER (WHERE o.channel = 'C1') AS n1, count(*) FILTER (WHERE o.channel = 'C2') AS n2 FROM og o JOIN rings r ON o.ix = r.ix AND o.iy = r.iy GROUP BY r.ring) SELECT a.ring, n1, n2, round(area, 6) AS area, round(n2 / n1::DOUBLE, 6) AS ratio, round(n1 / area, 6) AS density1, round(n2 / area, 6) AS density2 FROM a JOIN c ON a.ring = c.ring WHERE n1 > 5")
def ring_statistics(spark, d):
    on, _, mask = mask_of(spark, d)
    return shaped(raster.ring_statistics(raster.peel(mask, (*raster.FOUR, (0, 0))), on, 50.0, 5), "ring n1 n2", "area ratio density1 density2")


@query(f"WITH {MASK}, s AS (SELECT ix, iy FROM mask WHERE ix % 3 = 0) SELECT DISTINCT m.ix, m.iy FROM mask m JOIN s ON abs(m.ix - s.ix) + abs(m.iy - s.iy) <= 1")
def dilate_within(spark, d):
    mask = mask_of(spark, d)[2]
    return shaped(raster.dilate(mask.where("ix % 3 = 0"), raster.FOUR, mask), "ix iy")


@query(f"WITH {DISTANCE}, prof AS (SELECT unnest(range(0, 4)) AS step) SELECT ix, iy, round(1.0 / (2 + least(greatest(floor(distance) - 1, 0), 3)), 6) AS probability FROM dist")
def probability_map(spark, d):
    _, box, mask = mask_of(spark, d)
    profile = spark.range(4).select(F.col("id").cast("int").alias("step"), (1.0 / (F.col("id") + 2)).alias("value"))
    return shaped(raster.probability_map(raster.distance_map(mask, box), profile), "ix iy", "probability")


# --- spatial joins and profiles ------------------------------------------------------------------------------------------------

D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
RANGE3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 10000"


def rings_sql(name: str, own: str, other: str, same: bool) -> str:
    pair = f"{name}_p AS (SELECT a.id, least(greatest(ceil({D3} / 10), 1), 10)::BIGINT AS ring FROM pts a JOIN pts b ON {RANGE3} AND a.channel = '{own}' AND b.channel = '{other}'{' AND a.id <> b.id' if same else ''})"
    return f"{pair}, {name}_d AS (SELECT id, ring FROM pts, (SELECT unnest(range(1, 11)) AS ring) WHERE channel = '{own}'), {name} AS (SELECT d.id, d.ring, count(p.ring) FILTER (WHERE p.ring = d.ring) AS in_ring, count(p.ring) FILTER (WHERE p.ring <= d.ring) AS within FROM {name}_d d LEFT JOIN {name}_p p ON p.id = d.id GROUP BY d.id, d.ring)"


@query(f"WITH {PTS}, {rings_sql('r', 'C1', 'C1', True)} SELECT id, ring, in_ring, within FROM r")
def range_count_self(spark, d):
    p = channel(points(spark, d), "C1")
    return shaped(spatial.ring_counts(p, p, 100.0, same=True), "id ring in_ring within")


@query(f"WITH {PTS}, {rings_sql('r', 'C1', 'C2', False)} SELECT id, ring, in_ring, within FROM r")
def range_count_cross(spark, d):
    p = points(spark, d)
    return shaped(spatial.ring_counts(channel(p, "C1"), channel(p, "C2"), 100.0), "id ring in_ring within")


@query(f"WITH {PTS}, {rings_sql('r', 'C1', 'C2', False)}, f AS (SELECT ring, in_ring AS k, count(*) AS freq FROM r GROUP BY 1, 2), e AS (SELECT g.ring, k.i AS k FROM (SELECT ring, max(k) AS top FROM f GROUP BY ring) g, (SELECT unnest(range(0, 1000)) AS i) k WHERE k.i <= g.top) SELECT e.ring, e.k, coalesce(f.freq, 0) AS freq FROM e LEFT JOIN f ON e.ring = f.ring AND e.k = f.k")
def ring_histogram(spark, d):
    p = points(spark, d)
    return shaped(profiles.ring_histogram(spatial.ring_counts(channel(p, "C1"), channel(p, "C2"), 100.0)), "ring k freq")


RATIO = f"{PTS}, {rings_sql('o', 'C1', 'C1', True)}, {rings_sql('c', 'C1', 'C2', False)}, om AS (SELECT ring, avg(within) AS v FROM o GROUP BY ring), cm AS (SELECT ring, avg(within) AS v FROM c GROUP BY ring)"


@query(f"WITH {RATIO} SELECT om.ring, (om.ring * 10)::DOUBLE AS r, round(om.v, 6) AS own, round(cm.v, 6) AS other, round(om.v / nullif(cm.v, 0), 6) AS ratio FROM om JOIN cm ON om.ring = cm.ring")
def contact_ratio(spark, d):
    p = points(spark, d)
    return shaped(profiles.contact_ratio(channel(p, "C1"), channel(p, "C2"), 100.0), "ring", "r own other ratio")


@query(f"WITH {RATIO} SELECT ring, round(v / (4.0 / 3 * pi() * pow(ring * 10 / 32.0, 3)), 6) AS rdf FROM om")
def rdf(spark, d):
    p = channel(points(spark, d), "C1")
    return shaped(profiles.radial_distribution(p, p, 100.0, same=True), "ring", "rdf")


@query(f"WITH {RATIO} SELECT ring, round(v / (4.0 / 3 * pi() * pow(ring * 10 / 32.0, 3)), 6) AS rdf FROM cm")
def rdf_cross(spark, d):
    p = points(spark, d)
    return shaped(profiles.radial_distribution(channel(p, "C1"), channel(p, "C2"), 100.0), "ring", "rdf")


@query(f"WITH {PTS}, n AS (SELECT count(*) AS n FROM pts), r AS (SELECT unnest(range(1, 6)) AS ring), p AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts a JOIN pts b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500) SELECT r.ring, round((SELECT count(*) FROM p WHERE p.d <= r.ring * 10) * 1000000.0 / (n.n * (n.n - 1)), 6) AS k FROM r, n")
def ripley_k(spark, d):
    return shaped(profiles.ripley_k(points(spark, d), 50.0, 1e6), "ring", "k")


NEAR = f"{PTS}, near AS (SELECT a.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.id AS nid FROM pts a JOIN pts b ON abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 AND abs(a.z - b.z) <= 200), ranked AS (SELECT id, d2, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS k FROM near), knn AS (SELECT id, avg(sqrt(d2)) AS distance, count(*) AS found FROM ranked WHERE k <= 10 GROUP BY id)"


@query(f"WITH {NEAR} SELECT id, round(distance, 6) AS distance, found FROM knn")
def knn_mean(spark, d):
    p = points(spark, d)
    return shaped(spatial.mean_nearest(p, p, 10, 200.0), "id found", "distance")


@query(f"WITH {NEAR}, t AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS k, count(*) OVER () AS n FROM knn) SELECT id, round(distance, 6) AS distance FROM t WHERE k <= n - round(0.05 * n) - 1 AND distance > 0")
def knn_trim(spark, d):
    p = points(spark, d)
    return shaped(filters.trim_low_density(spatial.mean_nearest(p, p, 10, 200.0), "distance"), "id", "distance")


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), c AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer)
SELECT s.id, count(*) AS n FROM s JOIN c ON abs(s.v - c.v) <= 20 GROUP BY s.id""")
def range_join_1d(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return shaped(spatial.line_counts(s, c, 20.0, "v"), "id n")


@query("""WITH e AS (SELECT event_id AS id, date_trunc('minute', ts) AS f, value FROM events), p AS (SELECT f, min(id) AS first_id, max(id) AS second_id FROM e GROUP BY f HAVING count(*) = 2)
SELECT p.first_id, p.second_id, round(abs(b.value - a.value), 6) AS distance, abs(b.value - a.value) > 50 AS far FROM p JOIN e a ON a.id = p.first_id JOIN e b ON b.id = p.second_id""")
def pair_distance_two_event_frames(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("minute", "ts").alias("f"), "value")
    return shaped(spatial.paired_in_frames(e, "f", "value", far=50.0), "first_id second_id", "distance", "far")


# --- clusters ------------------------------------------------------------------------------------------------------------------

DBSCAN = f"""WITH RECURSIVE {PTS}, nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 8), ce AS (SELECT nb.a, nb.b FROM nb JOIN core c ON nb.b = c.id), cc AS (SELECT ce.a, ce.b FROM ce JOIN core c ON ce.a = c.id),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT cc.b, r.root FROM reach r JOIN cc ON cc.a = r.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id), num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS l FROM (SELECT DISTINCT c FROM comp)),
own AS (SELECT ce.a AS id, min(comp.c) AS c FROM ce JOIN comp ON ce.b = comp.id GROUP BY ce.a),
lab AS (SELECT p.id, p.x, p.y, p.z, p.channel, coalesce(num.l, -1)::BIGINT AS cluster_label FROM pts p LEFT JOIN own ON p.id = own.id LEFT JOIN num ON own.c = num.c)"""


def clustered(spark, d):
    return cluster.dbscan(points(spark, d), 25.0, 8)


@query(f"{DBSCAN} SELECT id, cluster_label FROM lab")
def dbscan(spark, d):
    return shaped(clustered(spark, d), "id cluster_label")


@query(f"{DBSCAN} SELECT cluster_label, count(*) AS n, round((max(x) - min(x) + max(y) - min(y)) / 2, 6) AS \"bb_2D\", round((max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 3, 6) AS \"bb_3D\" FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label")
def dbscan_sizes(spark, d):
    return shaped(cluster.cluster_sizes(clustered(spark, d)), "cluster_label n", "bb_2D bb_3D")


@query(f"{DBSCAN} SELECT cluster_label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label")
def dbscan_centroids(spark, d):
    return shaped(cluster.cluster_sizes(clustered(spark, d)), "cluster_label", "cx cy cz")


@query(f"{DBSCAN} SELECT id, CASE WHEN cluster_label = -1 THEN channel || '_noise' ELSE channel || '_clustered' END AS layer, 1.0::DOUBLE AS plot_size FROM lab")
def viewer_layers(spark, d):
    return shaped(filters.viewer_layers(clustered(spark, d).withColumn("sigma_x", F.lit(110.0))), "id", "plot_size", "layer")


@query(f"{DBSCAN}, c AS (SELECT cluster_label AS id, avg(x) AS x, avg(y) AS y FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label), r AS (SELECT unnest(range(1, 11)) AS ring) SELECT c.id, r.ring, count(p.id) AS within FROM c JOIN r ON true LEFT JOIN pts p ON sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) <= r.ring * 10 GROUP BY c.id, r.ring")
def centroid_profile(spark, d):
    return shaped(profiles.centroid_profile(points(spark, d), centres(spark, d), 100.0), "id ring within")


def centres_of(spark, d, name):
    """Centroids of the clusters of one channel's points, in three dimensions."""
    found = cluster.dbscan(channel(points(spark, d), name), 60.0, 4, ("x", "y", "z"))
    return cluster.cluster_sizes(found).select(F.col("cluster_label").cast("long").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


SOLID_DBSCAN = (
    DBSCAN.replace(PTS, PTS.replace("FROM embeddings", "FROM embeddings WHERE label % 2 = 0") + ", every AS (" + PTS.removeprefix("pts AS (")[:-1] + ")")
    .replace("(a.y - b.y) * (a.y - b.y) <= 625", "(a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 3600")
    .replace("count(*) >= 8", "count(*) >= 4")
)


@query(f"{SOLID_DBSCAN}, c AS (SELECT cluster_label AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label), r AS (SELECT unnest(range(1, 21)) AS ring) SELECT c.id, r.ring, count(b.id) AS within FROM c JOIN r ON true LEFT JOIN every b ON b.channel = 'C2' AND sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y) + (c.z - b.z) * (c.z - b.z)) <= r.ring * 10 GROUP BY c.id, r.ring")
def centroid_profile_3d(spark, d):
    """The second channel's points around the centroids of the first one's clusters, in three dimensions."""
    other = channel(points(spark, d), "C2")
    return shaped(profiles.centroid_profile(other, centres_of(spark, d, "C1"), 200.0, axes=("x", "y", "z")), "id ring within")


def centres(spark, d):
    return cluster.cluster_sizes(clustered(spark, d)).select(F.col("cluster_label").cast("long").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


@query(f"{DBSCAN}, c AS (SELECT cluster_label AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label), r AS (SELECT unnest(range(1, 11)) AS ring), p AS (SELECT c.id, least(greatest(ceil(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / 10), 1), 10)::BIGINT AS ring, abs(p.z - c.z) AS dz FROM c JOIN pts p ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 10000) SELECT c.id, r.ring, round(avg(p.dz), 6) AS dz FROM c JOIN r ON true LEFT JOIN p ON p.id = c.id AND p.ring = r.ring GROUP BY c.id, r.ring")
def dz_profile(spark, d):
    return shaped(profiles.axial_spread_profile(points(spark, d), centres(spark, d), 100.0), "id ring", "dz")


HULL = f"{PTS}, edge AS (SELECT a.label, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pts a JOIN pts b ON a.label = b.label AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.label = a.label AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)), hull AS (SELECT label, sum(x0 * y1 - x1 * y0) / 2 AS area FROM edge GROUP BY label)"


@query(f"WITH {HULL} SELECT label::BIGINT AS label, round(area, 3) AS area FROM hull")
def hull_area_2d(spark, d):
    g = cluster.cluster_geometry(points(spark, d), ("label",))
    return g.select(F.col("label").cast("long").alias("label"), F.round("hull_2D", 3).alias("area"))


@query(f"WITH {HULL}, n AS (SELECT label, count(*) AS n FROM pts GROUP BY label) SELECT h.label::BIGINT AS label, n.n, round(n.n / h.area, 9) AS density FROM hull h JOIN n ON n.label = h.label")
def density_2d(spark, d):
    g = cluster.cluster_geometry(points(spark, d), ("label",))
    return g.select(F.col("label").cast("long").alias("label"), "n", F.round("density_2D", 9).alias("density"))


# --- sampling and simulation -----------------------------------------------------------------------------------------------------


@query(f"WITH r AS (SELECT event_id AS id, row_number() OVER (ORDER BY {U.format(key='event_id::VARCHAR', seed=42)}, event_id) AS k, count(*) OVER () AS n FROM events), f AS (SELECT unnest(range(1, 11)) AS i) SELECT id, f.i / 10.0::DOUBLE AS fraction FROM r, f WHERE k <= round(n * f.i / 10.0)")
def sample_fractions(spark, d):
    return sampling.sample_fractions(table(spark, d, "events").select(F.col("event_id").alias("id")))


@query("SELECT id FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS k FROM events) WHERE (k - 1) % 7 = 0")
def stride_sample(spark, d):
    return sampling.stride_sample(table(spark, d, "events").select(F.col("event_id").alias("id")), 7)


PROB = f"{GRID}, prob AS (SELECT ix, iy, least(value / 20.0, 1.0) AS p, ix::VARCHAR || ',' || iy::VARCHAR AS cell FROM grid)"


def probabilities(spark, d):
    return raster.density_grid(points(spark, d)).select("ix", "iy", F.least(F.col("value") / 20.0, F.lit(1.0)).alias("probability"))


@query(f"WITH {PROB} SELECT ix, iy, round((ix + {U.format(key='cell', seed='x1')}) * 50, 6) AS x, round((iy + {U.format(key='cell', seed='y1')}) * 50, 6) AS y FROM prob WHERE {U.format(key='cell', seed=1)} < p")
def plant_seeds(spark, d):
    return shaped(sampling.plant_seeds(probabilities(spark, d)), "ix iy", "x y")


@query(f"""WITH RECURSIVE {PROB}, u AS (SELECT ix, iy, cell, p * 3 AS rate, {U.format(key='cell', seed=1)} AS u FROM prob),
walk(ix, iy, u, rate, k, pk, cdf) AS (SELECT ix, iy, u, rate, 0, exp(-rate), exp(-rate) FROM u UNION ALL SELECT ix, iy, u, rate, k + 1, pk * rate / (k + 1), cdf + pk * rate / (k + 1) FROM walk WHERE cdf <= u AND k < 60),
n AS (SELECT ix, iy, max(k) AS n FROM walk GROUP BY ix, iy), c AS (SELECT ix, iy, i.i AS copy, ix::VARCHAR || ',' || iy::VARCHAR || ',' || i.i::VARCHAR AS key FROM n, (SELECT unnest(range(1, 61)) AS i) i WHERE i.i <= n.n)
SELECT ix, iy, copy, round((ix + {U.format(key='key', seed='x1')}) * 50, 6) AS x, round((iy + {U.format(key='key', seed='y1')}) * 50, 6) AS y FROM c""")
def plant_seeds_poisson(spark, d):
    return shaped(sampling.plant_seeds_poisson(probabilities(spark, d), scale=3.0), "ix iy copy", "x y")


@query(f"""WITH h AS (SELECT r.ring, k.k, ((r.ring * 7 + k.k * 3) % 5 + 1) AS freq FROM (SELECT unnest(range(1, 4)) AS ring) r, (SELECT unnest(range(0, 4)) AS k) k),
c AS (SELECT ring, k, sum(freq) OVER (PARTITION BY ring ORDER BY k ROWS UNBOUNDED PRECEDING) / (sum(freq) OVER (PARTITION BY ring))::DOUBLE AS cdf FROM h),
s AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), roll AS (SELECT s.id, s.x, r.ring, {U.format(key="s.id::VARCHAR || ',' || r.ring::VARCHAR", seed=1)} AS u FROM s, (SELECT DISTINCT ring FROM h) r),
pick AS (SELECT roll.id, roll.x, roll.ring, min(c.k) AS k FROM roll JOIN c ON c.ring = roll.ring AND roll.u <= c.cdf GROUP BY 1, 2, 3),
e AS (SELECT id, x, ring, n.i AS copy, id::VARCHAR || ',' || ring::VARCHAR || ',' || n.i::VARCHAR AS key FROM pick, (SELECT unnest(range(1, 5)) AS i) n WHERE n.i <= k),
p AS (SELECT id, x, ring, copy, (ring + {U.format(key='key', seed='r1')}) * 10 AS r, 2 * pi() * {U.format(key='key', seed='t1')} AS t, acos(2 * {U.format(key='key', seed='p1')} - 1) AS p FROM e)
SELECT id AS seed_id, ring, copy, round(x + r * sin(p) * cos(t), 6) AS x, round(r * sin(p) * sin(t), 6) AS y, round(r * cos(p) * 1.5, 6) AS z FROM p""")
def spawn_domains(spark, d):
    ring, k = spark.range(1, 4).select(F.col("id").cast("int").alias("ring")), spark.range(4).select(F.col("id").alias("k"))
    histogram = ring.crossJoin(k).withColumn("freq", (F.col("ring") * 7 + F.col("k") * 3) % 5 + 1)
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed_id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return shaped(sampling.spawn_domains(seeds, histogram), "seed_id ring copy", "x y z")


# --- fits and profiles -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS priority, round(pow(10, regr_intercept(log10(o_totalprice), log10(o_custkey + 1))), 4) AS coef, round(regr_slope(log10(o_totalprice), log10(o_custkey + 1)), 6) AS exp, round(regr_r2(log10(o_totalprice), log10(o_custkey + 1)), 6) AS r2 FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority")
def power_law_fit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") + 1).cast("double").alias("density"), F.col("o_totalprice").alias("eps"))
    return fitting.power_law(o, "density", "eps", ["priority"]).select("priority", F.round("coef", 4).alias("coef"), F.round("exp", 6).alias("exp"), F.round("r2", 6).alias("r2"))


@query(" UNION ALL ".join("(" + DBSCAN.replace("<= 625", f"<= {e * e}") + f", s AS (SELECT (max(x) - min(x) + max(y) - min(y)) / 2 AS v FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label) SELECT {e}.0::DOUBLE AS eps, count(*) AS clusters, round(coalesce(abs(avg(v) - 60), 99999), 6) AS cost FROM s)" for e in (20, 25)))
def eps_grid_cost(spark, d):
    return shaped(fitting.eps_grid_cost(points(spark, d), (20.0, 25.0), 60.0), "clusters", "eps cost")


PROFILE = "prof AS (SELECT l_returnflag AS flag, month(l_shipdate) AS ring, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def monthly(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("ring")).agg(F.avg("l_extendedprice").alias("value"))


@query(f"WITH {PROFILE} SELECT flag, ring::BIGINT AS ring, round(s, 6) AS scaled FROM (SELECT flag, ring, (value - min(value) OVER (PARTITION BY flag)) / nullif(max(value) OVER (PARTITION BY flag) - min(value) OVER (PARTITION BY flag), 0) AS s FROM prof) WHERE ring <= 8")
def minmax_profile(spark, d):
    return shaped(profiles.min_max(monthly(spark, d), keys=["flag"], first=8), "ring", "scaled", "flag")


@query(f"""WITH {PROFILE}, f AS (SELECT flag, ring, value, CASE WHEN lead(value) OVER (PARTITION BY flag ORDER BY ring) < value THEN 1 ELSE 0 END AS falls FROM prof), b AS (SELECT *, max(falls) OVER (PARTITION BY flag ORDER BY ring ROWS UNBOUNDED PRECEDING) AS begun FROM f),
e AS (SELECT *, max(CASE WHEN begun = 1 AND falls = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY flag ORDER BY ring ROWS UNBOUNDED PRECEDING) AS ends FROM b) SELECT flag, ring::BIGINT AS ring, round(value, 6) AS value FROM e WHERE begun = 1 AND ends = 0 AND ring < 20""")
def monotone_segment(spark, d):
    return shaped(profiles.falling_segment(monthly(spark, d), keys=["flag"]), "ring", "value", "flag")


SIZES = "prof AS (SELECT p_brand AS flag, p_size AS ring, sum(p_retailprice) AS value FROM part GROUP BY 1, 2)"


def by_size(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("flag"), F.col("p_size").alias("ring")).agg(F.sum("p_retailprice").alias("value"))


@query(f"WITH {SIZES}, t AS (SELECT flag, ring, value, max(value) OVER (PARTITION BY flag) AS top FROM prof) SELECT flag, round(20.0 * min(ring) FILTER (WHERE value < 0.2 * top), 6)::DOUBLE AS width FROM t GROUP BY flag")
def first_below_20pct(spark, d):
    return shaped(profiles.width_at(by_size(spark, d), keys=["flag"]), "", "width", "flag")


@query(f"WITH {SIZES} SELECT flag, round(max(value) / avg(value) FILTER (WHERE ring BETWEEN 30 AND 50), 6) AS peak FROM prof GROUP BY flag")
def peak_stat(spark, d):
    return shaped(profiles.peak_statistic(by_size(spark, d), keys=["flag"], low=30, high=50), "", "peak", "flag")


@query("WITH c AS (SELECT o_orderpriority AS condition, o_custkey % 10 AS cell, month(o_orderdate) AS ring, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) SELECT condition, ring::BIGINT AS ring, round(avg(value) + 0.0000001, 4) AS mean, count(value) AS cells FROM c GROUP BY condition, ring")
def replicate_mean(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("condition"), (F.col("o_custkey") % 10).alias("cell"), F.month("o_orderdate").alias("ring")).agg(F.sum("o_totalprice").alias("value"))
    m = profiles.replicate_mean(o)
    return m.select("condition", F.col("ring").cast("long").alias("ring"), F.round(F.col("mean") + 0.0000001, 4).alias("mean"), "cells")


@query(f"WITH {SIZES} SELECT flag, ring::BIGINT AS ring, round(value / max(value) OVER (PARTITION BY flag), 6) AS scaled FROM prof")
def scaled_by_max(spark, d):
    return shaped(profiles.scaled_by_max(by_size(spark, d), keys=["flag"]), "ring", "scaled", "flag")


@query(f"WITH {SIZES} SELECT flag, ring::BIGINT AS ring, round(value / sum(value) OVER (PARTITION BY flag), 6) AS scaled FROM prof")
def scaled_to_sum(spark, d):
    return shaped(profiles.scaled_to_sum(by_size(spark, d), "value", ["flag"]), "ring", "scaled", "flag")


@query(f"WITH {PTS}, n AS (SELECT channel, floor(z / 10)::BIGINT AS slice, count(*) AS n FROM pts GROUP BY 1, 2) SELECT channel, slice, round(n / (sum(n) OVER (PARTITION BY channel))::DOUBLE, 6) AS share FROM n")
def slice_occupancy(spark, d):
    return shaped(profiles.slice_occupancy(points(spark, d), keys=["channel"]), "slice", "share", "channel")


@query("""WITH k AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM k),
g AS (SELECT 2.0::DOUBLE + i * 0.75 AS x FROM (SELECT unnest(range(0, 61)) AS i) WHERE 2.0 + i * 0.75 <= 40)
SELECT g.x, round(CASE WHEN g.x = s.x0 THEN s.y0 ELSE s.y0 + (s.y1 - s.y0) * (g.x - s.x0) / (s.x1 - s.x0) END, 6) AS y FROM g JOIN s ON g.x >= s.x0 AND (g.x < s.x1 OR (s.x1 IS NULL AND g.x = s.x0))""")
def interp_lookup(spark, d):
    return profiles.interpolated_lookup(table(spark, d, "part"), "p_size", "p_retailprice", 2.0, 40.0, 0.75).select("x", F.round("y", 6).alias("y"))


SUMS = "sum(e * e) AS ee, sum(a * x * e * e) AS exe, sum(a * a * x * x * e * e) AS xexe, sum(e * r) AS er, sum(a * x * e * r) AS xer"


def newton_sql(k: int) -> str:
    """A step of the normal equations of a e^(b x)."""
    return f"s{k} AS (SELECT flag, a + (er * xexe - xer * exe) / (ee * xexe - exe * exe) AS a, b + (xer * ee - er * exe) / (ee * xexe - exe * exe) AS b FROM (SELECT flag, any_value(a) AS a, any_value(b) AS b, {SUMS} FROM (SELECT p.flag, s.a, s.b, p.ring::DOUBLE AS x, exp(s.b * p.ring) AS e, p.value - s.a * exp(s.b * p.ring) AS r FROM prof p JOIN s{k - 1} s ON p.flag = s.flag) GROUP BY flag))"


@query(f"WITH {SIZES}, s0 AS (SELECT flag, exp(regr_intercept(ln(value), ring)) AS a, regr_slope(ln(value), ring) AS b FROM prof GROUP BY flag), {', '.join(map(newton_sql, range(1, 26)))} SELECT flag, round(a, 3) AS a, round(b, 8) AS b FROM s25")
def exp1_fit(spark, d):
    return fitting.exponential_fits(by_size(spark, d), ["flag"]).select("flag", F.round("a", 3).alias("a"), F.round("b", 8).alias("b"))


RESAMPLE = """p AS (SELECT flag, value, row_number() OVER (PARTITION BY flag ORDER BY ring) - 1 AS i, count(*) OVER (PARTITION BY flag) AS n FROM prof),
s AS (SELECT DISTINCT n, 100 // gcd(100, n) AS up, n // gcd(100, n) AS down, greatest(100, n) // gcd(100, n) AS wide FROM p), k AS (SELECT s.*, t.k, 5 * sqrt(greatest(1 - pow(t.k / (10.0 * wide), 2), 0)) AS x FROM s, (SELECT unnest(range(-2000, 2001)) AS k) t WHERE abs(t.k) <= 10 * wide),
raw AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / wide) / (pi() * k / wide) END * list_sum(list_transform(range(0, 31), lambda m: pow(x * x / 4, m) / pow(factorial(CAST(m AS INTEGER))::DOUBLE, 2))) AS h FROM k), taps AS (SELECT n, up, down, k, h * up / sum(h) OVER (PARTITION BY n) AS h FROM raw),
j AS (SELECT unnest(range(0, 100)) AS j)"""


@query(f"WITH {SIZES}, {RESAMPLE} SELECT p.flag, (j.j + 1)::BIGINT AS position, round(sum(p.value * t.h), 4) AS value FROM p CROSS JOIN j JOIN taps t ON t.n = p.n AND t.k = j.j * t.down - p.i * t.up GROUP BY p.flag, j.j")
def resample_100(spark, d):
    out = fitting.resampled(by_size(spark, d), ["flag"])
    return out.select("flag", F.col("position").cast("long").alias("position"), F.round("value", 4).alias("value"))


# --- text reader -----------------------------------------------------------------------------------------------------------------


LINES = "l AS (SELECT doc_id, line, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL))"


def document_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "value"))
    return docs.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "value")


@query(f"""WITH {LINES} SELECT doc_id, line - 1 AS line, translate(replace(regexp_replace(value, '[0-9]+', '#', 'g'), 'the ', 'THE '), ',;', '..') AS value FROM l WHERE line > 1 AND NOT contains(value, 'http') AND (contains(value, 'a') OR contains(value, 'e'))""")
def reader_ops(spark, d):
    """Replacements and line filters over all lines after the first."""
    out = text.clean_lines(document_lines(spark, d), [("[0-9]+", "#")], [(("the ",), "THE ")], [",;."], ["http"], ["a", "e"], header_lines=1)
    return out.select("doc_id", "line", "value")


@query(f"WITH {LINES} SELECT doc_id, line, value FROM l WHERE line BETWEEN 2 AND 20 AND line % 2 = 1")
def reader_rows(spark, d):
    """The reader's row range, and its predicate on line numbers."""
    return text.clean_lines(document_lines(spark, d), select=lambda n: n % 2 == 1, rows=(2, 20)).select("doc_id", "line", "value")


@query("SELECT event_id AS line FROM events WHERE (event_id BETWEEN 10 AND 40) OR (event_id BETWEEN 100 AND 100) OR (event_id BETWEEN 500 AND 900)")
def interval_rows(spark, d):
    spans = spark.createDataFrame([(10, 40), (100, 100), (500, 900)], "low long, high long")
    return text.in_intervals(table(spark, d, "events").select(F.col("event_id").alias("line")), spans)


#: Where the flagship query finds its tables.
ENTRY_DATA = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query on the smallest tables."""
    return contact_ratio(spark, ENTRY_DATA)


from nubila.plans import files, models  # noqa: E402, F401  (they register their queries here)
