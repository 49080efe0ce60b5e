"""Registered queries of scanner geometry, ray tracing, arithmetic of data sets and image analysis, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sinoflow.catalog import _BINS, _IMG, _MATRIX, _REC, _query
from sinoflow.functions import geometry
from sinoflow.operators import analysis, arith, listmode, raytrace, rebin, recon, reduce
from sinoflow.sources import tables
from sinoflow.sources.tables import BIN, VOXEL

SCANNER = geometry.Scanner(rings=8, detectors=64, radius=100.0, ring_spacing=4.0, span=3, tof_positions=8, tof_bin_ps=100.0, tof_mash=2)
SIZES = {s: 8 - abs(s) for s in range(-2, 3)}
_SEGMENT = "floor((r2 - r1 + 1) / 3.0)::INT"
_AXIAL = f"r1 + r2 - greatest(0, abs({_SEGMENT}) * 3 - 1)"
_PAIRS = """pairs AS (SELECT rec_no, d1, d2, ring AS r1, ((rec_no * 3 + d1) % 8)::INT AS r2, (rec_no % 8)::INT - 4 AS tof, (d1 - d2 + 96) % 64 AS t, (d1 - (((d1 - d2 + 96) % 64) >> 1) + 64) % 64 AS v FROM rec WHERE d1 <> d2),
folded AS (SELECT rec_no, d1, d2, v % 32 AS view, CASE WHEN v < 32 AND t < 32 THEN t WHEN v < 32 THEN 64 - t WHEN t < 32 THEN -t ELSE t - 64 END AS tang, CASE WHEN (v < 32) <> (t < 32) THEN r2 ELSE r1 END AS r1, CASE WHEN (v < 32) <> (t < 32) THEN r1 ELSE r2 END AS r2,
 CASE WHEN (v < 32) <> (t < 32) THEN -round(tof / 2.0)::INT - 1 ELSE round(tof / 2.0)::INT END AS tof FROM pairs)"""
_HALF = "other AS (SELECT segment, view, axial, tang, sum(value * (1 - weight)) AS value FROM bins GROUP BY ALL)"


def _pairs(spark, sf_dir):
    rows = tables.records(spark, sf_dir).filter("d1 <> d2")
    ring2, tof = F.pmod(F.col("rec_no") * 3 + F.col("d1"), F.lit(8)).cast("int"), (F.pmod("rec_no", F.lit(8)) - 4).cast("int")
    return rows.select("rec_no", "d1", F.col("ring").alias("ring1"), "d2", ring2.alias("ring2"), tof.alias("tof"))


def _other(spark, sf_dir):
    return tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum(F.col("value") * (1 - F.col("weight"))).alias("value"))


@_query(f"SELECT r1::INT AS ring1, r2::INT AS ring2, {_SEGMENT} AS segment, ({_AXIAL})::INT AS axial FROM range(8) a(r1), range(8) b(r2)")
def ring_pair_bins(spark, sf_dir):
    return geometry.ring_pairs(spark, SCANNER)


@_query(f"WITH {_REC}, {_PAIRS} SELECT rec_no, view, tang, {_SEGMENT} AS segment, ({_AXIAL})::INT AS axial, tof FROM folded")
def tof_bins(spark, sf_dir):
    return geometry.bin_of_pair(_pairs(spark, sf_dir), SCANNER).select("rec_no", "view", "tang", "segment", "axial", "tof")


@_query(f"WITH {_REC}, {_PAIRS} SELECT {_SEGMENT} AS segment, ({_AXIAL})::INT AS axial, view, tang, tof, count(*) AS value FROM folded GROUP BY ALL")
def listmode_binning_3d(spark, sf_dir):
    rows = geometry.bin_of_pair(_pairs(spark, sf_dir), SCANNER)
    return rows.groupBy("segment", "axial", "view", "tang", "tof").agg(F.count(F.lit(1)).alias("value"))


@_query(f"WITH {_REC}, {_PAIRS}, few AS (SELECT DISTINCT segment, axial, view, tang FROM (SELECT {_SEGMENT} AS segment, {_AXIAL} AS axial, view, tang FROM folded)), rp AS (SELECT r1::INT AS ring1, r2::INT AS ring2, {_SEGMENT} AS segment, {_AXIAL} AS axial FROM range(8) a(r1), range(8) b(r2)) "
        "SELECT f.segment, f.axial::INT AS axial, view, tang, ((view + (tang >> 1) + 64) % 64)::INT AS d1, ((view - ((tang + 1) >> 1) + 32 + 64) % 64)::INT AS d2, ring1, ring2 FROM few f JOIN rp USING (segment, axial)")
def detector_pairs_of_bins(spark, sf_dir):
    rows = geometry.bin_of_pair(_pairs(spark, sf_dir), SCANNER).select("segment", "axial", "view", "tang").distinct()
    return geometry.pairs_of_bin(rows, SCANNER).select("segment", "axial", "view", "tang", "d1", "d2", "ring1", "ring2")


@_query(f"WITH {_BINS}, g AS (SELECT segment, view, axial, tang, 100 * sin(tang * pi() / 64) AS s, view * 2 * pi() / 64 AS phi, (axial + greatest(0, abs(segment) * 3 - 1) - 7) * 2.0 AS m FROM proj), h AS (SELECT *, segment * 12 / (2 * sqrt(10000 - s * s)) AS tantheta FROM g) "
        "SELECT segment, view, axial, tang, s, phi, m, tantheta, m / sqrt(1 + tantheta * tantheta) AS t, axial * 100 * 2 * 0.299792458 / 2 AS k FROM h")
def bin_coordinates(spark, sf_dir):
    g, c = geometry, F.col
    return tables.projdata(spark, sf_dir).select(
        *BIN, g.s_of(c("tang"), SCANNER).alias("s"), g.phi_of(c("view"), SCANNER).alias("phi"), g.m_of(c("segment"), c("axial"), SCANNER).alias("m"),
        g.tan_theta_of(c("segment"), c("tang"), SCANNER).alias("tantheta"), g.t_of(c("segment"), c("axial"), c("tang"), SCANNER).alias("t"), g.k_of(c("axial"), SCANNER).alias("k"),
    )


@_query(f"WITH {_REC} SELECT rec_no, d1, d2, 100 * cos(d1 * pi() / 32) AS x1, 100 * sin(d1 * pi() / 32) AS y1, 100 * cos(d2 * pi() / 32) AS x2, 100 * sin(d2 * pi() / 32) AS y2, ring AS ring1, (rec_no % 8)::INT AS ring2 FROM rec")
def lines_to_detectors(spark, sf_dir):
    """Ends of lines, and the detectors found again next to points half a degree and a millimetre off them."""
    rows = tables.records(spark, sf_dir)
    x1, y1, x2, y2 = geometry.line_ends(F.col("d1"), F.col("d2"), SCANNER)
    rows = rows.select("rec_no", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (F.col("ring") * 4.0 + 1).alias("z1"), (F.pmod("rec_no", F.lit(8)) * 4.0 - 1).alias("z2"))
    turn = math.pi / 360
    off = lambda x, y, sign: (F.col(x) * math.cos(turn) - sign * F.col(y) * math.sin(turn), F.col(y) * math.cos(turn) + sign * F.col(x) * math.sin(turn))
    d1, r1, d2, r2 = geometry.nearest_pair(*off("x1", "y1", 1), F.col("z1"), *off("x2", "y2", -1), F.col("z2"), SCANNER)
    return rows.select("rec_no", d1.alias("d1"), d2.alias("d2"), "x1", "y1", "x2", "y2", r1.alias("ring1"), r2.alias("ring2"))


def _ray_sql(views: int, tang: int, n: int, spacing: float) -> str:
    return f"""r0 AS (SELECT v AS view, t, (t - {(tang - 1) / 2}) * {spacing} AS s, cos(v * pi() / {views}) AS c, sin(v * pi() / {views}) AS d FROM range({views}) a(v), range({tang}) b(t)),
r1 AS (SELECT *, (abs(c) < 1e-9 OR abs(d) < 1e-9) AND abs(s + {n / 2} - round(s + {n / 2})) < 1e-6 AS edge FROM r0),
r2 AS (SELECT view, t, c, d, s + unnest(CASE WHEN edge THEN [-1e-6, 1e-6] ELSE [0.0] END) AS s, CASE WHEN edge THEN 0.5 ELSE 1.0 END AS w FROM r1),
r3 AS (SELECT *, list_sort(CASE WHEN abs(d) < 1e-9 THEN [] ELSE list_transform(range({n + 1}), lambda k: (s * c - (k - {n / 2})) / d) END || CASE WHEN abs(c) < 1e-9 THEN [] ELSE list_transform(range({n + 1}), lambda k: ((k - {n / 2}) - s * d) / c) END) AS u FROM r2),
r4 AS (SELECT view, t, c, d, s, w, unnest(u[:-2]) AS lo, unnest(u[2:]) AS hi FROM r3),
ray AS (SELECT view::INT AS view, t::INT AS t, floor(s * d + (lo + hi) / 2 * c + {n / 2})::INT AS y, floor(s * c - (lo + hi) / 2 * d + {n / 2})::INT AS x, (hi - lo) * w AS a FROM r4 WHERE (hi - lo) * w > 1e-9)"""


@_query(f"WITH {_ray_sql(12, 13, 8, 0.9)} SELECT * FROM ray WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7")
def ray_traced_matrix(spark, sf_dir):
    return raytrace.ray_matrix(spark, 12, 13, 8, 0.9)


@_query(f"WITH {_IMG}, {_ray_sql(12, 12, 8, 1.0)} SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN ray USING (y, x) GROUP BY ALL")
def ray_traced_projection(spark, sf_dir):
    return recon.forward(raytrace.ray_matrix(spark, 12, 12, 8), tables.images(spark, sf_dir), ["image_id", "z"])


@_query(f"WITH {_BINS} SELECT segment, view, axial, tang, log(value + 1) * 0 + ln(value + 1) AS value FROM proj")
def logarithm(spark, sf_dir):
    rows = arith.combine([tables.projdata(spark, sf_dir)], BIN, including_first=True, add=1.0)
    return arith.apply(rows, "log")


@_query(f"WITH {_BINS}, {_HALF} SELECT segment, view, axial, tang, p.value + 2 * o.value + 2 * sqrt(p.value) AS value FROM proj p JOIN other o USING (segment, view, axial, tang)")
def summed_data_sets(spark, sf_dir):
    p, o = tables.projdata(spark, sf_dir), _other(spark, sf_dir)
    return arith.combine([arith.combine([p, o], BIN, times=2.0), p], BIN, power=0.5, times=2.0)


@_query(f"WITH {_BINS}, {_HALF} SELECT segment, view, axial, tang, p.value * (0.5 * o.value) AS value FROM proj p JOIN other o USING (segment, view, axial, tang)")
def multiplied_data_sets(spark, sf_dir):
    return arith.combine([tables.projdata(spark, sf_dir), _other(spark, sf_dir)], BIN, "multiply", times=0.5)


@_query(f"WITH {_BINS}, {_HALF} SELECT segment, view, axial, tang, 2 * p.value - o.value * o.value AS value FROM proj p JOIN other o USING (segment, view, axial, tang)")
def weighted_sum(spark, sf_dir):
    o = _other(spark, sf_dir)
    return arith.axpby(tables.projdata(spark, sf_dir), 2.0, o, arith.binary(o, o, BIN, "*").withColumn("value", -F.sqrt(F.col("value"))), BIN)


@_query(f"WITH {_BINS}, {_HALF} SELECT segment, view, axial, tang, CASE WHEN o.value = 0 THEN NULL ELSE abs((p.value - o.value) / o.value) END AS value FROM proj p JOIN other o USING (segment, view, axial, tang)")
def relative_differences(spark, sf_dir):
    p, o = tables.projdata(spark, sf_dir), _other(spark, sf_dir)
    return arith.apply(arith.binary(arith.binary(p, o, BIN, "-"), o, BIN, "/"), "abs")


@_query(f"WITH {_BINS}, {_HALF} SELECT segment, sum(p.value * o.value) AS inner, sqrt(sum(p.value ** 2)) AS norm_x, sqrt(sum(o.value ** 2)) AS norm_y, round(sum(p.value * o.value) / sqrt(sum(p.value ** 2)) / sqrt(sum(o.value ** 2)), 9) AS cosine FROM proj p JOIN other o USING (segment, view, axial, tang) GROUP BY 1")
def inner_products(spark, sf_dir):
    out = arith.inner_products(tables.projdata(spark, sf_dir), _other(spark, sf_dir), BIN, ["segment"])
    return out.withColumn("cosine", F.round(F.cos("angle"), 9)).drop("angle")


@_query(f"WITH {_BINS}, f AS (SELECT segment, view, axial, tang, 1 + max(weight) AS f FROM bins GROUP BY ALL) SELECT segment, view, axial, tang, value * f * (1 + 0.01 * abs(tang)) AS value FROM proj JOIN f USING (segment, view, axial, tang)")
def chained_normalisation(spark, sf_dir):
    first = tables.bins(spark, sf_dir).groupBy(*BIN).agg((1 + F.max("weight")).alias("value"))
    second = first.withColumn("value", 1 + 0.01 * F.abs("tang"))
    return arith.normalise(tables.projdata(spark, sf_dir), arith.chained_factors([first, second], BIN), BIN)


@_query(f"WITH {_BINS} SELECT segment, view, axial, tang, CASE WHEN segment = 0 AND axial IN (0, 7) THEN 0 ELSE value END AS value FROM proj")
def end_planes_zeroed(spark, sf_dir):
    return rebin.zero_end_planes(tables.projdata(spark, sf_dir), SIZES)


@_query(f"WITH {_BINS} SELECT segment, sum(value) AS value, row_number() OVER (ORDER BY abs(segment), segment DESC)::INT AS place FROM proj GROUP BY segment")
def segments_in_standard_order(spark, sf_dir):
    sums = tables.projdata(spark, sf_dir).groupBy("segment").agg(F.sum("value").alias("value"))
    ordered = arith.standard_order(sums).agg(F.collect_list(F.struct("segment", "value")).alias("rows"))  # a row a segment
    return ordered.select(F.posexplode("rows").alias("i", "r")).select("r.segment", "r.value", (F.col("i") + 1).cast("int").alias("place"))


@_query(f"WITH {_BINS} SELECT segment, view, axial, tang, value FROM proj WHERE abs(segment) <= 1 ORDER BY value DESC, segment, view, axial, tang LIMIT 20")
def largest_bins(spark, sf_dir):
    """The 20 largest bins of the middle segments: the report is the feature."""
    rows = tables.projdata(spark, sf_dir).filter("abs(segment) <= 1")
    return rows.orderBy(F.desc("value"), *BIN).limit(20)


def _direct_sql() -> str:
    parts = []
    for s, n in SIZES.items():
        parts.append(f"SELECT {s} AS segment, a AS new_axial, a - {(n - 1) / 2} + 3.5 AS pos FROM range({n}) r(a)")
    return f"""k AS ({" UNION ALL ".join(parts)}), kk AS (SELECT segment, new_axial, floor(pos)::INT + i AS axial, CASE WHEN i = 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM k, range(2) r(i))"""


@_query(f"WITH {_BINS}, {_direct_sql()} SELECT k.segment, view, new_axial::INT AS axial, tang, sum(w * value) AS value FROM kk k JOIN proj p ON p.segment = 0 AND p.axial = k.axial WHERE w > 0 GROUP BY k.segment, view, new_axial, tang")
def inverse_ssrb(spark, sf_dir):
    direct = tables.projdata(spark, sf_dir).filter("segment = 0").drop("segment")
    return rebin.inverse_ssrb(direct, 8, SIZES)


@_query(f"WITH {_IMG}, {_MATRIX}, p AS (SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL), o AS (SELECT view, t, sum(a) AS ones FROM m GROUP BY ALL) "
        "SELECT image_id, z, y, x, sum(a * ones * p.value / ((ones + 0.5) * (ones + 0.5))) AS value FROM p JOIN o USING (view, t) JOIN m USING (view, t) GROUP BY ALL")
def hessian_row_sums(spark, sf_dir):
    m, image = recon.parallel_matrix(spark, 8), tables.images(spark, sf_dir)
    return recon.hessian_row_sums(m, recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0)), ["image_id", "z"], 0.5)


@_query(f"WITH {_IMG}, q AS (SELECT image_id, CASE WHEN y < 3 THEN 'hot' WHEN y < 5 THEN 'cold' ELSE 'back' END AS region, avg(value) AS mean, stddev_pop(value) AS std FROM img GROUP BY ALL) "
        "SELECT image_id, (max(mean) FILTER (region = 'hot') / max(mean) FILTER (region = 'back') - 1) / 3 AS hot_recovery, 1 - max(mean) FILTER (region = 'cold') / max(mean) FILTER (region = 'back') AS cold_recovery, max(std) FILTER (region = 'back') / max(mean) FILTER (region = 'back') AS uniformity FROM q GROUP BY 1")
def contrast_recovery(spark, sf_dir):
    image = tables.images(spark, sf_dir).withColumn("region", F.when(F.col("y") < 3, "hot").when(F.col("y") < 5, "cold").otherwise("back"))
    regions = image.groupBy("image_id", "region").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return analysis.contrast(regions, ["image_id"], "hot", "cold", "back", 4.0)


@_query(f"WITH {_IMG}, s AS (SELECT image_id, sum(value) / count(*) AS mean, sum(value * value) / count(*) AS sq, count(*) AS n FROM img WHERE y BETWEEN 2 AND 5 GROUP BY 1) SELECT image_id, mean, sqrt(CASE WHEN sq - mean * mean < 1e-4 * mean * mean THEN 0 ELSE sq - mean * mean END) / mean AS cv FROM s")
def roi_variation(spark, sf_dir):
    return analysis.variation(reduce.roi_values(tables.images(spark, sf_dir), F.when(F.col("y").between(2, 5), 1.0).otherwise(0.0), ["image_id"])).select("image_id", "mean", "cv")


_FIRST = "m1 AS (SELECT DISTINCT ON (image_id) image_id, 1 AS rank, z, y, x, value FROM img ORDER BY image_id, value DESC, z, y, x)"
_NEXT = "(abs(i.z - {0}.z) > 1 OR abs(i.y - {0}.y) > 1 OR abs(i.x - {0}.x) > 1)"


@_query(f"WITH {_IMG}, {_FIRST}, m2 AS (SELECT DISTINCT ON (i.image_id) i.image_id, 2 AS rank, i.z, i.y, i.x, i.value FROM img i JOIN m1 USING (image_id) WHERE {_NEXT.format('m1')} ORDER BY i.image_id, i.value DESC, i.z, i.y, i.x), "
        f"m3 AS (SELECT DISTINCT ON (i.image_id) i.image_id, 3 AS rank, i.z, i.y, i.x, i.value FROM img i JOIN m1 USING (image_id) JOIN m2 USING (image_id) WHERE {_NEXT.format('m1')} AND {_NEXT.format('m2')} ORDER BY i.image_id, i.value DESC, i.z, i.y, i.x) "
        "SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3")
def image_maxima(spark, sf_dir):
    return analysis.find_maxima(tables.images(spark, sf_dir), ["image_id"], 3)


@_query(f"""WITH {_IMG}, {_FIRST}, l AS (SELECT i.image_id, i.x, i.value, m1.x AS top, m1.value AS high FROM img i JOIN m1 ON i.image_id = m1.image_id AND i.z = m1.z AND i.y = m1.y),
n AS (SELECT image_id, any_value(top) AS top, any_value(high) AS high, max(value) FILTER (x = top - 1) AS b, max(value) FILTER (x = top + 1) AS a FROM l GROUP BY 1),
c AS (SELECT image_id, top, 0.5 * coalesce(CASE WHEN b - 2 * high + a < 0 THEN high - (a - b) * (a - b) / (8 * (b - 2 * high + a)) ELSE high END, high) AS cut FROM n),
r AS (SELECT l.image_id, min(x) AS x FROM l JOIN c USING (image_id) WHERE l.x > l.top AND value < cut GROUP BY 1), f AS (SELECT l.image_id, max(x) AS x FROM l JOIN c USING (image_id) WHERE l.x < l.top AND value < cut GROUP BY 1)
SELECT c.image_id, 2.0 * ((r.x - 1 + (r1.value - cut) / (r1.value - r2.value)) - (f.x + 1 - (f1.value - cut) / (f1.value - f2.value))) AS width FROM c LEFT JOIN r USING (image_id) LEFT JOIN f USING (image_id)
LEFT JOIN l r1 ON r1.image_id = c.image_id AND r1.x = r.x - 1 LEFT JOIN l r2 ON r2.image_id = c.image_id AND r2.x = r.x LEFT JOIN l f1 ON f1.image_id = c.image_id AND f1.x = f.x + 1 LEFT JOIN l f2 ON f2.image_id = c.image_id AND f2.x = f.x""")
def half_maximum_widths(spark, sf_dir):
    return analysis.width_at(tables.images(spark, sf_dir), ["image_id"], "x", 0.5, 2.0)


@_query(f"""WITH {_IMG}, f AS (SELECT image_id, z, y, x, z + 0.25 AS az, y + 0.1 * x - 0.3 AS ay, x - 0.5 AS ax FROM img),
k AS (SELECT f.*, floor(az)::INT + kz AS sz, floor(ay)::INT + ky AS sy, floor(ax)::INT + kx AS sx, (CASE WHEN kz = 1 THEN az - floor(az) ELSE 1 - az + floor(az) END) * (CASE WHEN ky = 1 THEN ay - floor(ay) ELSE 1 - ay + floor(ay) END) * (CASE WHEN kx = 1 THEN ax - floor(ax) ELSE 1 - ax + floor(ax) END) AS w FROM f, range(2) a(kz), range(2) b(ky), range(2) c(kx))
SELECT k.image_id, k.z, k.y, k.x, sum(w * coalesce(img.value, 0)) AS value FROM k LEFT JOIN img ON img.image_id = k.image_id AND img.z = sz AND img.y = sy AND img.x = sx GROUP BY ALL""")
def displaced_images(spark, sf_dir):
    image = tables.images(spark, sf_dir)
    field = image.select(*VOXEL, F.lit(0.25).alias("dz"), (0.1 * F.col("x") - 0.3).alias("dy"), F.lit(-0.5).alias("dx"))
    return analysis.displaced(image, field, ["image_id"])


@_query(f"WITH {_IMG}, s AS (SELECT image_id, z + 1 AS z, y, x - 2 AS x, value FROM img), f AS (SELECT DISTINCT image_id, y, x FROM s), p AS (SELECT image_id, g::INT AS z, y, x FROM f, range(0, 10) q(g)) SELECT p.*, coalesce(value, 0) AS value FROM p LEFT JOIN s USING (image_id, z, y, x)")
def shifted_and_padded(spark, sf_dir):
    return analysis.padded(analysis.shifted(tables.images(spark, sf_dir), {"z": 1, "x": -2}), ["image_id"], 0, 9)


@_query(f"WITH {_IMG} SELECT image_id, z, y, x, value FROM img WHERE z = 3 AND x = 4")
def lines_through_images(spark, sf_dir):
    return analysis.line_through(tables.images(spark, sf_dir), "y", {"z": 3, "x": 4})


@_query("""WITH c AS (SELECT p_brand, p_size::DOUBLE AS t, avg(p_retailprice) AS v FROM part GROUP BY ALL), l AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY t)),
f AS (SELECT * FROM (VALUES (1, 0.0, 7.5), (2, 7.5, 20.0), (3, 30.0, 60.0)) q(frame, a, b)), k AS (SELECT *, greatest(t, a) AS lo, least(t2, b) AS hi FROM l, f WHERE t2 > t AND t2 > a AND t < b)
SELECT p_brand, frame, sum((hi - lo) * ((v + (v2 - v) * (lo - t) / (t2 - t)) + (v + (v2 - v) * (hi - t) / (t2 - t))) / 2) / max(b - a) AS value FROM k GROUP BY ALL""")
def curve_frame_means(spark, sf_dir):
    curve = tables.load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("t")).agg(F.avg("p_retailprice").alias("value"))
    return analysis.frame_means(curve, [(0.0, 7.5), (7.5, 20.0), (30.0, 60.0)], ["p_brand"])


@_query(f"WITH {_REC}, s AS (SELECT ring AS unit, time_ms // 7200000 * 7200.0 AS a, (time_ms // 7200000 + 1) * 7200.0 AS b, count(*) AS n FROM rec GROUP BY ALL) SELECT unit, (sum(n * (least(b, 500000) - greatest(a, 100000)) / (b - a)) / 400000)::DOUBLE AS rate FROM s WHERE b > 100000 AND a < 500000 GROUP BY 1")
def singles_rates(spark, sf_dir):
    slot = F.floor(F.col("time_ms") / 7_200_000)
    slices = tables.records(spark, sf_dir).groupBy(F.col("ring").alias("unit"), slot.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return listmode.rate_in(slices.select("unit", (F.col("k") * 7200.0).alias("start_s"), ((F.col("k") + 1) * 7200.0).alias("end_s"), "n"), 100_000.0, 500_000.0)


@_query()
def events_kept_at_random(spark, sf_dir):
    return listmode.keep_at_random(tables.records(spark, sf_dir), 0.3)


@_query()
def poisson_noise(spark, sf_dir):
    return analysis.poisson_noise(tables.projdata(spark, sf_dir), BIN, 0.1, preserve_mean=True)
