"""Registered queries of the model, simulation and morphology operators, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from nubila.functions.core import ranked
from nubila.operators import cluster, filters, fitting, imaging, profiles, raster, sampling, spatial
from nubila.plans.queries import BANDS, BOX, DBSCAN, DISTANCE, GRID, HULL, MASK, PEEL, PROB, PTS, RATIO, SIZES, U, by_size, centres, channel, clustered, gridded, mask_of, monthly, points, probabilities, query, rings_sql, shaped, table, wavelengths

HISTOGRAM = f"{PTS}, {rings_sql('r', 'C1', 'C2', False)}, f AS (SELECT ring, in_ring AS k, count(*) AS freq FROM r GROUP BY 1, 2)"
EXPECTED = f"{HISTOGRAM}, e AS (SELECT ring, sum(freq * (k + 0.5)) / sum(freq) / (pi() * 100 * (ring * ring - (ring - 1) * (ring - 1))) AS value FROM f GROUP BY ring)"


def histogram_of(spark, d, share=False):
    p = points(spark, d)
    return profiles.ring_histogram(spatial.ring_counts(channel(p, "C1"), channel(p, "C2"), 100.0), share=share)


# --- profiles ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {HISTOGRAM} SELECT ring, k, round(freq / sum(freq) OVER (PARTITION BY ring), 6) AS freq FROM f")
def histogram_share(spark, d):
    return shaped(histogram_of(spark, d, True).where("freq > 0"), "ring k", "freq")


@query(f"WITH {EXPECTED} SELECT ring, round(value, 6) AS value FROM e")
def expected_shell_counts(spark, d):
    return shaped(profiles.expected_shell_counts(histogram_of(spark, d)), "ring", "value")


@query(f"WITH {EXPECTED}, s AS (SELECT ring, value - min(value) OVER () AS v FROM e), t AS (SELECT ring, v, max(v) OVER () AS top FROM s) SELECT round(20.0 * min(ring) FILTER (WHERE v < 0.2 * top), 6)::DOUBLE AS width FROM t")
def ground_truth_width(spark, d):
    return shaped(profiles.ground_truth_width(histogram_of(spark, d)), "", "width")


@query(f"WITH {PTS}, {rings_sql('r', 'C1', 'C1', True)} SELECT id, ring, greatest(within - coalesce(lag(within) OVER (PARTITION BY id ORDER BY ring), 0), 0) AS in_ring FROM r")
def ring_difference(spark, d):
    p = channel(points(spark, d), "C1")
    counts = spatial.ring_counts(p, p, 100.0, same=True).select("id", "ring", "within")
    return shaped(profiles.ring_difference(counts, "within", ["id"]), "id ring in_ring")


@query(f"WITH {SIZES} SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY ring) AS ring, round(value, 6) AS value FROM prof WHERE NOT (ring = 1 AND value > 1000)")
def unstable_start(spark, d):
    return shaped(filters.drop_unstable_start(by_size(spark, d), "value", ["flag"], limit=1000.0), "ring", "value", "flag")


@query("""WITH m AS (SELECT l_returnflag AS flag, month(l_shipdate) AS ring, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), j AS (SELECT f.ring, f.value AS factor, s.value / r.value AS ratio FROM m f JOIN m r ON r.flag = 'R' AND r.ring = f.ring JOIN m s ON s.flag = 'N' AND s.ring = f.ring WHERE f.flag = 'A')
SELECT ring::BIGINT AS ring, round(ratio, 6) AS ratio, round(factor / ratio, 6) AS factor, round(max(abs(ratio - 1)) OVER (), 6) AS dif FROM j""")
def calibration_step(spark, d):
    m = monthly(spark, d)
    one = lambda flag: m.where(F.col("flag") == flag).select("ring", "value")
    return shaped(profiles.calibration_update(one("R"), one("N"), one("A")), "ring", "ratio factor dif")


RATIO_C = f"{PTS}, {rings_sql('o', 'C1', 'C1', True)}, {rings_sql('c', 'C1', 'C2', False)}, om AS (SELECT ring, avg(within) AS v FROM o GROUP BY ring), cm AS (SELECT ring, avg(within) AS v FROM c GROUP BY ring), q AS (SELECT om.ring, om.v / nullif(cm.v, 0) AS v FROM om JOIN cm ON om.ring = cm.ring), k AS (SELECT row_number() OVER (ORDER BY ring) AS ring, v FROM q WHERE NOT (ring = 1 AND coalesce(v, 0) > 1e6)), n AS (SELECT ring, (v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0) AS value FROM k)"


@query(f"""WITH {RATIO_C}, f AS (SELECT ring, value, CASE WHEN lead(value) OVER (ORDER BY ring) < value THEN 1 ELSE 0 END AS falls FROM n WHERE ring <= 20), b AS (SELECT *, max(falls) OVER (ORDER BY ring ROWS UNBOUNDED PRECEDING) AS begun FROM f),
e AS (SELECT *, max(CASE WHEN begun = 1 AND falls = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ring ROWS UNBOUNDED PRECEDING) AS ends FROM b) SELECT ring, (ring * 10)::DOUBLE AS r, round(value, 6) AS value FROM e WHERE begun = 1 AND ends = 0 AND ring < 20""")
def decay_segments(spark, d):
    p = points(spark, d)
    return shaped(profiles.decay_segments(channel(p, "C1"), channel(p, "C2"), 100.0), "ring", "r value")


@query()
def decay_constants(spark, d):
    p = points(spark, d)
    return profiles.decay_constants(channel(p, "C1"), channel(p, "C2"), 100.0, keys=["cell_id"])


@query(f"""{DBSCAN}, s AS (SELECT cluster_label, min(channel) AS channel FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label), w AS (SELECT a.id, a.channel, count(b.id) - 1 AS within FROM pts a JOIN pts b ON a.channel = b.channel AND {"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 10000"} GROUP BY a.id, a.channel)
SELECT n1, n2, round(n1 / n2::DOUBLE, 6) AS ratio, clusters1, clusters2, round(w1 / n1, 6) AS surround1, round(w2 / n2, 6) AS surround2 FROM (SELECT count(*) FILTER (WHERE channel = 'C1') AS n1, count(*) FILTER (WHERE channel = 'C2') AS n2 FROM pts), (SELECT count(*) FILTER (WHERE channel = 'C1') AS clusters1, count(*) FILTER (WHERE channel = 'C2') AS clusters2 FROM s), (SELECT avg(within) FILTER (WHERE channel = 'C1') AS w1, avg(within) FILTER (WHERE channel = 'C2') AS w2 FROM w)""")
def abundance(spark, d):
    p = points(spark, d)
    counts = spatial.ring_counts(p, p, 100.0, keys=["channel"], same=True).where("ring = 10").select("channel", "id", "within")
    groups = clustered(spark, d).where("cluster_label <> -1").groupBy("cluster_label").agg(F.min("channel").alias("channel"))
    return shaped(profiles.abundance(p, groups, counts), "n1 n2 clusters1 clusters2", "ratio surround1 surround2")


RINGS2 = "(SELECT a.id, least(greatest(ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 10), 1), 10)::BIGINT AS ring FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000)"


@query(f"""WITH {BANDS}, px AS (SELECT band, count(*) AS pixels FROM bands GROUP BY band), pt AS (SELECT b.band, count(*) AS points FROM og o JOIN bands b ON o.ix = b.ix AND o.iy = b.iy GROUP BY b.band),
i AS (SELECT p.id, s.ring, count(q.id) AS k FROM pts p JOIN (SELECT unnest(range(1, 11)) AS ring) s ON true LEFT JOIN {RINGS2} q ON q.id = p.id AND q.ring = s.ring GROUP BY p.id, s.ring), h AS (SELECT ring, k, count(*) AS freq FROM i GROUP BY ring, k), every AS (SELECT t.ring, v.k FROM (SELECT ring, max(k) AS top FROM h GROUP BY ring) t, (SELECT unnest(range(0, 3000)) AS k) v WHERE v.k <= t.top)
SELECT 'profile' AS kind, px.band AS step, NULL::BIGINT AS k, round(coalesce(points, 0) / pixels::DOUBLE, 6) AS value FROM px LEFT JOIN pt ON px.band = pt.band WHERE px.band >= 1
UNION ALL SELECT 'ring', e.ring, e.k, coalesce(h.freq, 0)::DOUBLE FROM every e LEFT JOIN h ON h.ring = e.ring AND h.k = e.k
UNION ALL SELECT 'z', ring, NULL, 1.5::DOUBLE FROM (SELECT unnest(range(1, 11)) AS ring) UNION ALL SELECT 'origin', 0, NULL, round(x0, 6) FROM box UNION ALL SELECT 'origin', 1, NULL, round(y0, 6) FROM box""")
def empirical_parameters(spark, d):
    p, box, _ = gridded(spark, d)
    bands = raster.radial_bands(raster.distance_map(mask_of(spark, d)[2], box), 10)
    return shaped(profiles.empirical_parameters(p, bands, box, 50.0, 100.0), "step k", "value", "kind")


# --- rows and columns --------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, round(0.02 * s * s + 3.5 * s + 640, 6) AS wavelength, round((-3.5 + sqrt(3.5 * 3.5 - 4 * 0.02 * (640 - (0.02 * s * s + 3.5 * s + 640)))) / (2 * 0.02), 6) AS displacement FROM (SELECT event_id, (event_id % 50) / 10.0::DOUBLE AS s FROM events)")
def spectral_calibration(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 50) / 10.0).alias("s"))
    e = e.withColumn("wavelength", filters.wavelength_of(F.col("s"), 0.02, 3.5, 640.0))
    return shaped(e.withColumn("displacement", filters.displacement_of(F.col("wavelength"), 0.02, 3.5, 640.0)), "id", "wavelength displacement")


COLOR = ", ".join(f"round({U.format(key='label::VARCHAR', seed=f'color{k}')}, 6) AS c{k}" for k in range(3))


@query(f"WITH l AS (SELECT DISTINCT label FROM embeddings) SELECT label::BIGINT AS label, {COLOR}, 1.0::DOUBLE AS alpha FROM l UNION ALL SELECT -1, 0.7, 0.7, 0.7, 0.5")
def cluster_colors(spark, d):
    labels = points(spark, d).select("label").distinct().unionByName(spark.range(1).select(F.lit(-1).alias("label")))
    c = labels.withColumn("color", filters.cluster_color(F.col("label")))
    return shaped(c.select("label", *[F.col("color")[k].alias(f"c{k}") for k in range(3)], F.col("color")[3].alias("alpha")), "label", "c0 c1 c2 alpha")


@query("WITH n AS (SELECT count(*) AS n FROM events), f AS (SELECT unnest(range(1, 6)) AS i) SELECT f.i / 5.0::DOUBLE AS fraction, round(n * f.i / 5.0)::BIGINT AS rows, 40.0::DOUBLE + 10 * f.i AS target FROM f, n")
def fraction_targets(spark, d):
    samples = sampling.sample_fractions(table(spark, d, "events").select(F.col("event_id").alias("id")), 5)
    targets = spark.createDataFrame([(i / 5, 40.0 + 10 * i) for i in range(1, 6)], "fraction double, target double")
    return shaped(fitting.with_targets(samples.groupBy("fraction").agg(F.count("*").alias("rows")), targets), "rows", "fraction target")


@query("SELECT event_id AS id, row_number() OVER (ORDER BY date_trunc('minute', ts), event_id) AS place FROM events")
def frame_order(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("minute", "ts").alias("frame"))
    return ranked(e, "frame", "id", rank="place").select("id", F.col("place").cast("long").alias("place"))


@query("WITH n AS (SELECT count(*) AS n FROM events), p AS (SELECT DISTINCT (1 + round(i * (n - 1) / 6.0))::BIGINT AS place FROM n, (SELECT unnest(range(0, 7)) AS i)), r AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS place FROM events) SELECT r.id, r.place FROM r JOIN p ON r.place = p.place")
def plot_picks(spark, d):
    return sampling.evenly_picked(table(spark, d, "events").select(F.col("event_id").alias("id")), 7).select("id", F.col("place").cast("long").alias("place"))


@query(f"WITH {PTS} SELECT id, channel, cell_id AS replicate, round(x, 6) AS x FROM pts")
def channel_union(spark, d):
    p = points(spark, d)
    split = [channel(p, c).where(F.col("cell_id") == r).select("id", "x").withColumn("channel", F.lit(c)).withColumn("replicate", F.lit(r)) for c in ("C1", "C2") for r in range(4)]
    return shaped(filters.stacked(split), "id replicate", "x", "channel")


@query(f"WITH {GRID} SELECT round(quantile_cont(value, 0.99), 6) AS upper FROM grid")
def plot_limit(spark, d):
    return shaped(filters.plot_limit(raster.density_grid(points(spark, d)), "value"), "", "upper")


# --- raster ------------------------------------------------------------------------------------------------------------------------

VOXELS = f"{PTS}, low AS (SELECT min(x) AS x0, min(y) AS y0 FROM pts)"


@query(f"WITH {VOXELS} SELECT round(count(*) * 0.0025, 6)::DOUBLE AS area FROM (SELECT DISTINCT floor((x + 0.01 - x0) / 50), floor((y + 0.01 - y0) / 50) FROM pts, low)")
def projected_area(spark, d):
    return shaped(raster.projected_area(raster.voxel_counts(points(spark, d), 50.0), 50.0), "", "area")


def _taps(name: str, sigma: int, radius: int) -> str:
    """A kernel and its taps along both axes, borders replicated."""
    return f"{name}k AS (SELECT i, exp(-0.5 * i * i / {sigma * sigma}.0) AS w FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS i)), {name}w AS (SELECT i, w / (SELECT sum(w) FROM {name}k) AS w FROM {name}k), {name}x AS (SELECT t.i AS t, w.w, least(greatest(t.i + w.i, 0), nx - 1) AS s FROM (SELECT unnest(range(0, 200)) AS i) t, {name}w w, box WHERE t.i < nx), {name}y AS (SELECT t.i AS t, w.w, least(greatest(t.i + w.i, 0), ny - 1) AS s FROM (SELECT unnest(range(0, 200)) AS i) t, {name}w w, box WHERE t.i < ny)"


def _smoothed(name: str, source: str) -> str:
    return f"{name}1 AS (SELECT x.t AS ix, g.iy, sum(x.w * g.value) AS value FROM {name}x x JOIN {source} g ON x.s = g.ix GROUP BY 1, 2), {name} AS (SELECT p.ix, y.t AS iy, sum(y.w * p.value) AS value FROM {name}y y JOIN {name}1 p ON y.s = p.iy GROUP BY 1, 2)"


@query(f"WITH {GRID}, {_taps('one', 1, 2)}, {_smoothed('one', 'grid')}, cut AS (SELECT ix, iy, 1.0 AS value FROM one WHERE value > 0.7), {_taps('two', 2, 4)}, {_smoothed('two', 'cut')} SELECT ix, iy, round(value, 6) AS value FROM two WHERE value > 0.001")
def two_step_mask(spark, d):
    p, box, _ = gridded(spark, d)
    return shaped(raster.two_step_mask(raster.density_grid(p, 50.0, box=box), box, 0.7).where("value > 0.001"), "ix iy", "value")


@query(f"WITH {GRID}, {_taps('one', 1, 2)}, {_smoothed('one', 'grid')}, cut AS (SELECT ix, iy, 1.0 AS value FROM one WHERE value > 0.7 AND (ix * 7 + iy * 3) % 5 <> 0), {_taps('two', 2, 4)}, {_smoothed('two', 'cut')} SELECT ix, iy, round(value, 6) AS value FROM two WHERE value > 0.001")
def mask_product(spark, d):
    """The smoothed and cut mask inside another mask, smoothed again."""
    p, box, _ = gridded(spark, d)
    within = raster.dense(box).where((F.col("ix") * 7 + F.col("iy") * 3) % 5 != 0)
    return shaped(raster.two_step_mask(raster.density_grid(p, 50.0, box=box), box, 0.7, within).where("value > 0.001"), "ix iy", "value")


@query(f"""WITH RECURSIVE {MASK}, reach(ix, iy, rx, ry) AS (SELECT ix, iy, ix, iy FROM mask UNION SELECT m.ix, m.iy, r.rx, r.ry FROM reach r JOIN mask m ON abs(m.ix - r.ix) <= 1 AND abs(m.iy - r.iy) <= 1) SELECT ix, iy, min(rx * 1000 + ry) AS component FROM reach GROUP BY ix, iy""")
def components_8(spark, d):
    parts = raster.components(mask_of(spark, d)[2], raster.EIGHT)
    return shaped(parts.select("ix", "iy", (F.col("component.ix") * 1000 + F.col("component.iy")).alias("component")), "ix iy component")


WIDE = "wide AS (SELECT a.i AS ix, b.i AS iy FROM box, (SELECT unnest(range(-6, 210)) AS i) a, (SELECT unnest(range(-6, 210)) AS i) b WHERE a.i <= nx + 5 AND b.i <= ny + 5)"


@query(f"WITH RECURSIVE {GRID}, mask AS (SELECT ix, iy FROM grid WHERE value > 0), {WIDE}, steps(ix, iy, k) AS (SELECT w.ix, w.iy, 0 FROM wide w LEFT JOIN mask m ON w.ix = m.ix AND w.iy = m.iy WHERE m.ix IS NULL UNION SELECT m.ix, m.iy, s.k + 1 FROM steps s JOIN mask m ON (m.ix - s.ix) * (m.ix - s.ix) + (m.iy - s.iy) * (m.iy - s.iy) <= 25 WHERE s.k < 6) SELECT ix, iy, min(k)::BIGINT AS ring FROM steps WHERE k > 0 GROUP BY ix, iy")
def peel_disk(spark, d):
    on, _, _ = mask_of(spark, d)
    return shaped(raster.peel(on.select("ix", "iy").distinct()), "ix iy ring")


OUTWARD = "grown(ix, iy, k) AS (SELECT ix, iy, 0 FROM mask WHERE (ix * 31 + iy * 17) % 11 = 0 UNION SELECT m.ix, m.iy, g.k + 1 FROM grown g JOIN mask m ON abs(m.ix - g.ix) + abs(m.iy - g.iy) = 1 WHERE g.k < 60), outward AS (SELECT ix, iy, min(k)::BIGINT AS ring FROM grown GROUP BY ix, iy HAVING min(k) > 0)"


def outward_rings(mask):
    return raster.peel(mask.where("(ix * 31 + iy * 17) % 11 = 0"), raster.FOUR, inward=False, within=mask)


@query(f"WITH RECURSIVE {MASK}, {OUTWARD} SELECT ix, iy, ring FROM outward")
def dilation_rings(spark, d):
    return shaped(outward_rings(mask_of(spark, d)[2]), "ix iy ring")


@query(f"WITH RECURSIVE {PEEL}, {OUTWARD}, own AS (SELECT ix, iy, 1.0 / (1 + ring) AS density, pow(0.5 + ring / 10.0, 1.5) AS ratio FROM rings), theirs AS (SELECT ix, iy, 2.0 / (1 + ring) AS density, (1.0 + ring) / 2.5 + 0.45 AS ratio FROM outward WHERE ring <= round((SELECT max(ring) FROM outward) / 4.0)) SELECT coalesce(a.ix, b.ix) AS ix, coalesce(a.iy, b.iy) AS iy, round(greatest(a.density, b.density), 6)::DOUBLE AS density, round(greatest(a.ratio, b.ratio), 6)::DOUBLE AS ratio FROM own a FULL JOIN theirs b ON a.ix = b.ix AND a.iy = b.iy")
def weighted_rings(spark, d):
    mask = mask_of(spark, d)[2]
    inner, outer = raster.peel(mask, (*raster.FOUR, (0, 0))), outward_rings(mask)
    ring = spark.range(1, 100).select(F.col("id").cast("int").alias("ring"))
    profile = ring.select("ring", (1.0 / (1 + F.col("ring"))).alias("density"), (0.5 + F.col("ring") / 10.0).alias("ratio"))
    second = ring.select("ring", (2.0 / (1 + F.col("ring"))).alias("density"), (1.0 + F.col("ring")).alias("ratio"))
    return shaped(raster.weighted_rings(inner, profile, outer, second), "ix iy", "density ratio")


# --- clusters ----------------------------------------------------------------------------------------------------------------------


@query(f"{DBSCAN} SELECT id, CASE WHEN cluster_label = -1 THEN -1 ELSE cluster_label + 1 END AS cluster_label FROM lab")
def dbscan_from_one(spark, d):
    return shaped(cluster.dbscan(points(spark, d), 25.0, 8, first_label=1), "id cluster_label")


@query("SELECT o_orderkey AS id, round(12.5 * pow(o_totalprice, -0.35), 6) AS eps FROM orders")
def adaptive_radius(spark, d):
    o = table(spark, d, "orders")
    return shaped(o.select(F.col("o_orderkey").alias("id"), cluster.adaptive_radius(F.col("o_totalprice"), 12.5, -0.35).alias("eps")), "id", "eps")


@query(f"{DBSCAN}, s AS (SELECT (max(x) - min(x) + max(y) - min(y)) / 2 AS v FROM lab WHERE cluster_label <> -1 GROUP BY cluster_label) SELECT 25.0::DOUBLE AS eps, round(coalesce(avg(v) - 60, -100), 6) AS cost FROM s")
def signed_cost(spark, d):
    cost = fitting.signed_cost(points(spark, d), 25.0, 60.0)
    return shaped(spark.createDataFrame([(25.0, cost)], "eps double, cost double"), "", "eps cost")


@query(f"WITH {PTS}, b AS (SELECT label, count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 0) AS density FROM pts GROUP BY label) SELECT label::BIGINT AS label, round(density * 1e6, 6) AS density, row_number() OVER (ORDER BY density, label) <= round(count(*) OVER () / 2.0) AS sparse FROM b")
def sparse_clusters(spark, d):
    half = cluster.sparse_half(points(spark, d), "label")
    return half.select(F.col("label").cast("long").alias("label"), F.round(F.col("density") * 1e6, 6).alias("density"), "sparse")


@query("SELECT count(*) AS points, 10::BIGINT AS clusters, 0::BIGINT AS misplaced FROM embeddings")
def kmeans_is_nearest(spark, d):
    return shaped(cluster.misplaced(cluster.kmeans(points(spark, d), 10), "kmeans_label"), "points clusters misplaced")


STEP = """m{k} AS (SELECT label, coalesce(avg(p.x), any_value(m.x)) AS x, coalesce(avg(p.y), any_value(m.y)) AS y, coalesce(avg(p.z), any_value(m.z)) AS z FROM m{j} m LEFT JOIN g{j} p USING (label) GROUP BY label)"""
GIVE = """g{k} AS (SELECT p.id, p.x, p.y, p.z, min_by(m.label, ((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z), m.label)) AS label FROM pts p, m{k} m GROUP BY ALL)"""


@query(f"WITH {PTS}, m0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS label, x, y, z FROM pts ORDER BY id LIMIT 6), {GIVE.format(k=0)}, " + ", ".join(f"{STEP.format(k=k, j=k - 1)}, {GIVE.format(k=k)}" for k in range(1, 5)) + " SELECT id, label::BIGINT AS label FROM g4")
def kmeans_steps(spark, d):
    """Four steps of k-means from the first six points."""
    p = points(spark, d)
    seeds = ranked(p.orderBy("id").limit(6), "id").select((F.col("rank") - 1).alias("kmeans_label"), "x", "y", "z")
    return shaped(cluster.lloyd(p.drop("label"), seeds, 4).withColumnRenamed("kmeans_label", "label"), "id label")


@query(
    f"WITH {PTS}, m0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS label, x, y, z FROM pts ORDER BY id LIMIT 6), {GIVE.format(k=0)}, " + ", ".join(f"{STEP.format(k=k, j=k - 1)}, {GIVE.format(k=k)}" for k in range(1, 5))
    + f", b AS (SELECT label, count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 0) AS density FROM g4 GROUP BY label), s AS (SELECT label, CASE WHEN row_number() OVER (ORDER BY density, label) <= round(count(*) OVER () / 2.0) THEN 0 ELSE 1 END AS class FROM b) SELECT p.id, CASE WHEN {U.format(key='p.id::VARCHAR', seed=6)} < 0.1 THEN 1 - class ELSE class END::BIGINT AS class FROM g4 p JOIN s USING (label)"
)
def segment_by_kmeans(spark, d):
    """Two classes of points by the density of their k-means clusters, each flipped with a probability."""
    p = points(spark, d)
    seeds = ranked(p.orderBy("id").limit(6), "id").select((F.col("rank") - 1).alias("kmeans_label"), "x", "y", "z")
    return shaped(cluster.segment_by_clusters(cluster.lloyd(p, seeds, 4), "kmeans_label", 0.1, 6), "id class")


SPAN = "span AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span, count(*) AS n FROM pts)"
ADAPTIVE = f"""{PTS}, {SPAN}, reach AS (SELECT l, span / 70 * pow(2, l) AS r, span / 70 * pow(2, l) >= span AS last FROM span, (SELECT unnest(range(0, 8)) AS l)),
near AS (SELECT reach.l, reach.last, a.id, b.id AS nid, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN reach ON true JOIN pts b ON abs(a.x - b.x) <= r AND abs(a.y - b.y) <= r AND abs(a.z - b.z) <= r),
level AS (SELECT id, min(l) AS l FROM (SELECT id, l, last, count(*) AS c FROM near GROUP BY id, l, last) WHERE c >= least(10, (SELECT n FROM span)) OR last GROUP BY id),
pick AS (SELECT near.id, d2, row_number() OVER (PARTITION BY near.id ORDER BY d2, nid) AS k FROM near JOIN level ON near.id = level.id AND near.l = level.l), mean AS (SELECT id, avg(sqrt(d2)) FILTER (WHERE k > 1) AS distance FROM pick WHERE k <= 11 GROUP BY id)"""


@query(f"WITH {ADAPTIVE} SELECT id, round(distance, 6) AS distance, CASE WHEN distance > 100 THEN 1 ELSE 0 END::BIGINT AS class FROM mean")
def adaptive_knn_class(spark, d):
    return shaped(filters.threshold_class(spatial.adaptive_mean_nearest(points(spark, d)), "distance", 100.0), "id class", "distance")


@query(f"WITH {ADAPTIVE}, c AS (SELECT id, CASE WHEN distance > 100 THEN 1 ELSE 0 END AS class FROM mean) SELECT id, CASE WHEN {U.format(key='id::VARCHAR', seed=4)} < 0.05 THEN 1 - class ELSE class END::BIGINT AS class FROM c")
def segment_by_neighbours(spark, d):
    return shaped(cluster.segment_by_neighbours(points(spark, d), 100.0, 0.05, 4), "id class")


@query(f"WITH {PTS}, b AS (SELECT label, count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 0) AS density FROM pts GROUP BY label), s AS (SELECT label, CASE WHEN row_number() OVER (ORDER BY density, label) <= round(count(*) OVER () / 2.0) THEN 0 ELSE 1 END AS class FROM b) SELECT p.id, CASE WHEN {U.format(key='p.id::VARCHAR', seed=6)} < 0.1 THEN 1 - class ELSE class END::BIGINT AS class FROM pts p JOIN s ON p.label = s.label")
def segment_by_clusters(spark, d):
    return shaped(cluster.segment_by_clusters(points(spark, d), "label", 0.1, 6), "id class")


DET = "(b.x - a.x) * ((c.y - a.y) * ({d}.z - a.z) - (c.z - a.z) * ({d}.y - a.y)) - (b.y - a.y) * ((c.x - a.x) * ({d}.z - a.z) - (c.z - a.z) * ({d}.x - a.x)) + (b.z - a.z) * ((c.x - a.x) * ({d}.y - a.y) - (c.y - a.y) * ({d}.x - a.x))"
SOLID = f"{PTS}, face AS (SELECT a.label, a.x * (b.y * c.z - b.z * c.y) - a.y * (b.x * c.z - b.z * c.x) + a.z * (b.x * c.y - b.y * c.x) AS v FROM pts a JOIN pts b ON a.label = b.label AND a.id < b.id JOIN pts c ON a.label = c.label AND a.id < c.id AND b.id <> c.id WHERE NOT EXISTS (SELECT 1 FROM pts e WHERE e.label = a.label AND {DET.format(d='e')} > 1e-6)), solid AS (SELECT label, sum(v) / 6 AS volume FROM face GROUP BY label)"


@query(f"WITH {PTS}, face AS (SELECT a.label, a.id AS a, b.id AS b, c.id AS c FROM pts a JOIN pts b ON a.label = b.label AND a.id < b.id JOIN pts c ON a.label = c.label AND a.id < c.id AND b.id <> c.id WHERE NOT EXISTS (SELECT 1 FROM pts e WHERE e.label = a.label AND {DET.format(d='e')} > 1e-6)), corner AS (SELECT label, a AS id FROM face UNION SELECT label, b FROM face UNION SELECT label, c FROM face) SELECT p.label::BIGINT AS label, count(*) AS corners, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM corner JOIN pts p ON p.id = corner.id GROUP BY p.label")
def hull_corner_centroids(spark, d):
    """Mean of the corners of each cluster's hull, and how many there are."""
    g = cluster.cluster_geometry(points(spark, d), ("label",)).where("hull_3D > 0")
    return shaped(g.select("label", F.size("vertices").alias("corners"), *[F.col(f"centroid.{a}").alias(f"c{a}") for a in "xyz"]), "label corners", "cx cy cz")


@query(f"WITH {SOLID}, n AS (SELECT label, count(*) AS n FROM pts GROUP BY label) SELECT n.label::BIGINT AS label, n.n, round(volume, 2) AS volume, round(n.n / volume * 1e6, 6) AS density FROM n JOIN solid ON n.label = solid.label")
def hull_volume_3d(spark, d):
    g = cluster.cluster_geometry(points(spark, d), ("label",))
    return g.select(F.col("label").cast("long").alias("label"), "n", F.round("hull_3D", 2).alias("volume"), F.round(F.col("density_3D") * 1e6, 6).alias("density"))


FLAT, BULK = (part.removeprefix(f"{PTS}, ").replace("pts", "q") for part in (HULL, SOLID))


@query(f"""{DBSCAN}, q AS MATERIALIZED (SELECT id, x, y, z, cluster_label AS label FROM lab WHERE cluster_label <> -1), {FLAT}, {BULK}, b AS (SELECT label, count(*) AS n, (max(x) - min(x) + max(y) - min(y)) / 2 AS bb2, (max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 3 AS bb3 FROM q GROUP BY label),
j AS (SELECT b.*, coalesce(h.area, 0) AS area, coalesce(s.volume, 0) AS volume, b.n >= 4 AND coalesce(h.area, 0) > 0 AND coalesce(s.volume, 0) > 0 AS sound FROM b LEFT JOIN hull h ON h.label = b.label LEFT JOIN solid s ON s.label = b.label)
SELECT label AS cluster_label, n, round(CASE WHEN sound THEN area ELSE 0 END, 3) AS "hull_2D", round(CASE WHEN sound THEN volume ELSE 0 END, 2) AS "hull_3D", round(CASE WHEN sound THEN bb2 ELSE 0 END, 6) AS "bb_2D", round(CASE WHEN sound THEN bb3 ELSE 0 END, 6) AS "bb_3D", round(CASE WHEN sound THEN n / area ELSE 0 END, 9) AS "density_2D", round(CASE WHEN sound THEN n / volume ELSE 0 END, 9) AS "density_3D" FROM j""")
def cluster_characteristics(spark, d):
    g = cluster.cluster_geometry(clustered(spark, d))
    digits = {"hull_2D": 3, "hull_3D": 2, "bb_2D": 6, "bb_3D": 6, "density_2D": 9, "density_3D": 9}
    return g.select(F.col("cluster_label").cast("long").alias("cluster_label"), "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


# --- simulation --------------------------------------------------------------------------------------------------------------------

CHANCES = f"chance AS (SELECT ix, iy, ix % 5 AS iz, ix::VARCHAR || ',' || iy::VARCHAR || ',' || (ix % 5)::VARCHAR AS cell, 3e8 * value * (1 + ix % 5) / (561000000.0 * 2) AS t_m, coalesce(2e8 * value / nullif(0.5 * (iy % 3), 0), 0) * CASE WHEN iy % 3 = 0 THEN 0 ELSE 1 + ix % 5 END / (425110000.0 * 2) AS t_a FROM grid)"


@query(f"WITH {GRID}, {CHANCES}, roll AS (SELECT *, {U.format(key='cell', seed=3)} AS u FROM chance) SELECT ix, iy, round(t_m, 6) AS t_m, round(t_a, 6) AS t_a, CASE WHEN u < t_m THEN 'C1' ELSE 'C2' END AS channel FROM roll WHERE u < t_m OR u > 1 - t_a")
def two_channel_seeds(spark, d):
    cells = raster.density_grid(points(spark, d)).select("ix", "iy", (F.col("ix") % 5).alias("iz"), F.col("value").cast("double").alias("density"), (0.5 * (F.col("iy") % 3)).alias("ratio"), (1.0 + F.col("ix") % 5).alias("slice_share"))
    return shaped(sampling.plant_two_channels(sampling.seed_thresholds(cells, 3e8, 2e8, 2.0), 3), "ix iy", "t_m t_a", "channel")


@query(f"WITH {PROB}, s AS (SELECT ix, iy, floor({U.format(key='cell', seed='z1')} * (SELECT count(*) FROM pts)) + 1 AS place FROM prob WHERE {U.format(key='cell', seed=1)} < p), z AS (SELECT z, row_number() OVER (ORDER BY id) AS place FROM pts) SELECT ix, iy, round(z, 6) AS z FROM s JOIN z ON s.place = z.place")
def seeds_with_z(spark, d):
    return shaped(sampling.with_random_z(sampling.plant_seeds(probabilities(spark, d)), points(spark, d).select("id", "z")), "ix iy", "z")


@query(f"""WITH h AS (SELECT r.ring, k.k, ((r.ring * 7 + k.k * 3) % 5 + 1) AS freq, 0.05 * r.ring AS ratio, 1.0 + r.ring / 10.0 AS z_ratio FROM (SELECT unnest(range(1, 4)) AS ring) r, (SELECT unnest(range(0, 4)) AS k) k),
c AS (SELECT *, sum(freq) OVER (PARTITION BY ring ORDER BY k ROWS UNBOUNDED PRECEDING) / (sum(freq) OVER (PARTITION BY ring))::DOUBLE AS cdf, round((round(k / (6 * ratio)) + round((k + 1) / (6 * ratio))) / 2) AS n FROM h),
roll AS (SELECT s_suppkey AS id, s_acctbal AS x, r.ring, {U.format(key="s_suppkey::VARCHAR || ',' || r.ring::VARCHAR", seed=1)} AS u FROM supplier, (SELECT DISTINCT ring FROM h) r),
pick AS (SELECT roll.*, c.n, c.z_ratio, row_number() OVER (PARTITION BY roll.id, roll.ring ORDER BY c.k) AS j FROM roll JOIN c ON c.ring = roll.ring AND roll.u < c.cdf),
e AS (SELECT id, x, ring, z_ratio, i.i AS copy, id::VARCHAR || ',' || ring::VARCHAR || ',' || i.i::VARCHAR AS key FROM pick, (SELECT unnest(range(1, 50)) AS i) i WHERE j = 1 AND i.i <= n),
p AS (SELECT *, (ring + {U.format(key='key', seed='r1')}) * 10 AS far, 2 * pi() * {U.format(key='key', seed='t1')} AS t, (ring + 2 * {U.format(key='key', seed='a1')} - 1) * 10 AS axial, CASE WHEN {U.format(key='key', seed='s1')} < 0.5 THEN -1.0 ELSE 1.0 END AS side FROM e)
SELECT id AS seed_id, ring, copy, round(x + far * cos(t), 6) AS x, round(far * sin(t), 6) AS y, round(2.8 * side * sqrt(axial * axial / 2) / z_ratio, 6) AS z FROM p""")
def spawn_rings(spark, d):
    ring = spark.range(1, 4).select(F.col("id").cast("int").alias("ring"))
    histogram = ring.crossJoin(spark.range(4).select(F.col("id").alias("k"))).withColumn("freq", (F.col("ring") * 7 + F.col("k") * 3) % 5 + 1)
    shrink = ring.select("ring", (0.05 * F.col("ring")).alias("ratio"), (1.0 + F.col("ring") / 10.0).alias("z_ratio"))
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed_id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return shaped(sampling.spawn_rings(seeds, histogram, shrink), "seed_id ring copy", "x y z")


def _normal(seed: str) -> str:
    return f"sqrt(-2 * ln(1 - {U.format(key='key', seed=seed.replace('*', 'a'))})) * cos(2 * pi() * {U.format(key='key', seed=seed.replace('*', 'b'))})"


@query(f"WITH g AS (SELECT l_linenumber AS frame, floor(l_quantity / 5)::BIGINT AS ix, floor(l_extendedprice / 5000)::BIGINT AS iy, count(*)::DOUBLE AS photons FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT *, frame::VARCHAR || ',' || ix::VARCHAR || ',' || iy::VARCHAR AS key FROM g) SELECT frame::BIGINT AS frame, ix, iy, round(greatest(photons + sqrt(2 - 1 / 300.0) * sqrt(photons) * {_normal('s*1')} + 1.0 * {_normal('r*1')}, 0), 6) AS signal FROM k")
def camera_noise(spark, d):
    pixels = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), F.floor(F.col("l_quantity") / 5).alias("ix"), F.floor(F.col("l_extendedprice") / 5000).alias("iy")).agg(F.count("*").cast("double").alias("photons"))
    return shaped(sampling.camera_noise(pixels), "frame ix iy", "signal")


SPECTRUM = ([-10.0, 0.0, 10.0], [1.0, 2.0, 1.0])


@query("""WITH b AS (SELECT (s_suppkey % 3)::BIGINT AS frame, 200.0 + (s_suppkey * 37) % 800 AS x, 150.0 + (s_suppkey * 53) % 700 AS y, 80.0 + s_suppkey % 40 AS sx, 90.0 + s_suppkey % 30 AS sy, 100.0 + s_suppkey % 50 AS i, 660.0 + s_suppkey % 40 AS wave, s_suppkey AS id FROM supplier),
s AS (SELECT b.*, b.x / 100 + 0.05 * (wave + o.o - 680) AS place, o.w / 4.0 AS w, o.o FROM b, (VALUES (-10.0, 1.0), (0.0, 2.0), (10.0, 1.0)) o(o, w)),
gx AS (SELECT id, o, p.i AS ix, exp(-0.5 * ((p.i - place) / (sx / 100)) * ((p.i - place) / (sx / 100))) AS g FROM s, (SELECT unnest(range(0, 16)) AS i) p), gy AS (SELECT id, o, p.i AS iy, exp(-0.5 * ((p.i - y / 100) / (sy / 100)) * ((p.i - y / 100) / (sy / 100))) AS g FROM s, (SELECT unnest(range(0, 12)) AS i) p),
t AS (SELECT s.frame, gx.ix, gy.iy, s.i * s.w * gx.g / sum(gx.g) OVER (PARTITION BY s.id, s.o, gy.iy) * gy.g / sum(gy.g) OVER (PARTITION BY s.id, s.o, gx.ix) AS v FROM s JOIN gx ON gx.id = s.id AND gx.o = s.o JOIN gy ON gy.id = s.id AND gy.o = s.o)
SELECT frame, ix, iy, round(sum(v), 4) AS photons FROM t GROUP BY frame, ix, iy HAVING sum(v) > 0.001""")
def camera_frames(spark, d):
    k = F.col("s_suppkey")
    blinks = table(spark, d, "supplier").select((k % 3).cast("int").alias("frame"), (200.0 + (k * 37) % 800).alias("x"), (150.0 + (k * 53) % 700).alias("y"), (80.0 + k % 40).alias("sigma_x"), (90.0 + k % 30).alias("sigma_y"), (100.0 + k % 50).alias("intensity"), (660.0 + k % 40).alias("wavelength"))
    frames = imaging.camera_frames(blinks, 12, 16, 100.0, SPECTRUM, (0.05, 680.0)).where("photons > 0.001")
    return frames.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "ix", "iy")], F.round("photons", 4).alias("photons"))


def _walk(radius: int, middle: int) -> str:
    """The outline's vertices and the cells of its edges."""
    return f"w AS (SELECT i AS o, 0.02 * sqrt(-2 * ln(1 - {U.format(key='i::VARCHAR', seed='a1')})) * cos(2 * pi() * {U.format(key='i::VARCHAR', seed='b1')}) AS step FROM (SELECT unnest(range(1, 251)) AS i)), c AS (SELECT o, sum(step) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS walk, sum(step) OVER () AS final FROM w), v AS (SELECT o, round({middle} + {radius} * exp(walk - final * o / 250.0) * cos(2 * pi() * o / 250))::BIGINT AS ix, round({middle} + {radius} * exp(walk - final * o / 250.0) * sin(2 * pi() * o / 250))::BIGINT AS iy FROM c), e AS (SELECT ix, iy, coalesce(lead(ix) OVER (ORDER BY o), first_value(ix) OVER (ORDER BY o)) AS jx, coalesce(lead(iy) OVER (ORDER BY o), first_value(iy) OVER (ORDER BY o)) AS jy FROM v), line AS (SELECT DISTINCT round(ix + (jx - ix) * k.k / n::DOUBLE)::BIGINT AS ix, round(iy + (jy - iy) * k.k / n::DOUBLE)::BIGINT AS iy FROM (SELECT *, greatest(abs(jx - ix), abs(jy - iy), 1) AS n FROM e), (SELECT unnest(range(0, 400)) AS k) k WHERE k.k <= n)"


@query(f"WITH {_walk(60, 100)} SELECT ix, iy FROM line")
def nucleus_outline(spark, d):
    return shaped(raster.outline(sampling.random_outline(spark, centre=(100.0, 100.0))), "ix iy")


@query(f"WITH RECURSIVE {_walk(12, 20)}, cells AS (SELECT a.i AS ix, b.i AS iy FROM (SELECT unnest(range(-1, 41)) AS i) a, (SELECT unnest(range(-1, 41)) AS i) b), free AS (SELECT c.ix, c.iy FROM cells c LEFT JOIN line l ON c.ix = l.ix AND c.iy = l.iy WHERE l.ix IS NULL), outside(ix, iy) AS (SELECT ix, iy FROM free WHERE ix = -1 AND iy = -1 UNION SELECT f.ix, f.iy FROM outside o JOIN free f ON (f.ix = o.ix AND (f.iy = o.iy + 1 OR f.iy = o.iy - 1)) OR (f.iy = o.iy AND (f.ix = o.ix + 1 OR f.ix = o.ix - 1))) SELECT c.ix, c.iy FROM cells c LEFT JOIN outside o ON c.ix = o.ix AND c.iy = o.iy WHERE o.ix IS NULL")
def filled_nucleus(spark, d):
    shape = spark.range(1).select(F.lit(40).alias("nx"), F.lit(40).alias("ny"))
    return shaped(raster.filled_outline(sampling.random_outline(spark, radius=12.0, centre=(20.0, 20.0)), shape), "ix iy")


@query()
def nucleus_parts(spark, d):
    """A small nucleus of two slices with one nucleolus."""
    return sampling.random_nucleus(spark, 2, 9.0, 1, 2.0, 60, 20)


LOOP = ", ".join(f"l{k} AS (SELECT ring, n, r, 3 * n * sqrt(factor) / r AS ratio, factor / (3 * n * sqrt(factor) / r) AS factor, {k} AS k FROM l{k - 1})" for k in range(1, 11))


@query(
    f"WITH m AS (SELECT l_returnflag AS flag, month(l_shipdate) AS ring, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), l0 AS (SELECT s.ring, s.value AS n, r.value AS r, 1.0::DOUBLE AS factor FROM m s JOIN m r ON s.ring = r.ring AND s.flag = 'N' AND r.flag = 'R'), {LOOP}, "
    f"w AS ({' UNION ALL '.join(f'SELECT ring, ratio, factor, k FROM l{k}' for k in range(1, 11))}), d AS (SELECT k, max(abs(ratio - 1)) AS dif FROM w GROUP BY k), e AS (SELECT coalesce(min(k) FILTER (WHERE dif <= 0.3), 10) AS k FROM d) SELECT ring::BIGINT AS ring, w.k::BIGINT AS rounds, round(factor, 6) AS factor, round(dif, 6) AS dif FROM w JOIN e ON w.k = e.k JOIN d ON d.k = w.k"
)
def calibration_loop(spark, d):
    """Factors whose model comes within a third of a measured profile; the model goes with their root, so several rounds are needed."""
    m = monthly(spark, d)
    one = lambda flag: m.where(F.col("flag") == flag).select("ring", "value")
    base = one("N").withColumnRenamed("value", "base")
    model = lambda factors: factors.join(base, "ring").select("ring", (3 * F.col("base") * F.sqrt("value")).alias("value"))
    found, rounds = fitting.calibrated_factors(model, one("R"), one("N").select("ring", F.lit(1.0).alias("factor")))
    return shaped(found.withColumn("rounds", F.lit(rounds)), "ring rounds", "factor dif")


# --- searches ----------------------------------------------------------------------------------------------------------------------


@query()
def bounded_radius(spark, d):
    """Radius in [10, 200] whose mean cluster size comes nearest to 60."""
    eps, cost = fitting.find_eps(points(spark, d), 60.0)
    return spark.createDataFrame([(eps, cost)], "eps double, cost double")


@query()
def halving_radii(spark, d):
    """Radius for each of two densities by step halving, each search starting at the last result less two."""
    samples = sampling.sample_fractions(points(spark, d), 2)
    return fitting.chained_radii(samples, {1.0: 60.0, 0.5: 80.0})
