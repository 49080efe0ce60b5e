"""Registered queries of weighted priors, penalised and kernel reconstruction, frames, gates and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoflow.catalog import _BINS, _IMG, _MATRIX, _REC, _query
from sinoflow.catalog_geometry import _ray_sql
from sinoflow.catalog_recon import _DATA, _NEAR, _phantom
from sinoflow.functions import geometry, scalar
from sinoflow.operators import analysis, frames, penalised, raytrace, recon, resample, stencil
from sinoflow.sources import tables
from sinoflow.sources.tables import BIN, VOXEL

_KAPPA = "1 + 0.1 * {0}.z + 0.05 * {0}.x"
_PAIR = f"pair AS (SELECT s.image_id, s.z, s.y, s.x, s.value AS a, t.value AS b, s.x * 0.5 AS u, t.x * 0.5 AS v, w, w * ({_KAPPA.format('s')}) * ({_KAPPA.format('t')}) AS k FROM img s, near n, img t WHERE t.image_id = s.image_id AND t.z = s.z + dz AND t.y = s.y + dy AND t.x = s.x + dx)"
SINGLE = geometry.Scanner(rings=8, detectors=64, radius=100.0, ring_spacing=4.0)


def _kappa(image):
    return image.select(*VOXEL, (1 + 0.1 * F.col("z") + 0.05 * F.col("x")).alias("value"))


@_query(f"WITH {_IMG}, {_NEAR}, {_PAIR} SELECT image_id, z, y, x, sum(k * (a - b) * (a - b) / 4) AS prior, sum(k * (a - b)) AS gradient FROM pair GROUP BY ALL")
def weighted_quadratic_prior(spark, sf_dir):
    image = tables.images(spark, sf_dir)
    return penalised.weighted_prior(image, ["image_id"], "quadratic", _kappa(image))


@_query(f"WITH {_IMG}, {_NEAR}, {_PAIR} SELECT image_id, z, y, x, sum(w * CASE WHEN abs(a - b) < 0.01 THEN 1 - (a - b) ** 2 / 3 ELSE tanh(a - b) / (a - b) END) AS curvature FROM pair GROUP BY ALL")
def logcosh_curvature(spark, sf_dir):
    return penalised.surrogate_curvature(tables.images(spark, sf_dir), ["image_id"], "logcosh")


@_query(f"WITH {_IMG}, {_NEAR}, {_PAIR} SELECT image_id, z, y, x, sum(k * 2 * (2 * b + 0.1) * ((2 * b + 0.1) * u - (2 * a + 0.1) * v) / (a + b + 2 * abs(a - b) + 0.1) ** 3) AS output FROM pair GROUP BY ALL")
def relative_difference_hessian(spark, sf_dir):
    image = tables.images(spark, sf_dir)
    return penalised.hessian_times(image.withColumn("input", F.col("x") * 0.5), ["image_id"], "relative_difference", _kappa(image), epsilon=0.1)


def _ossps_sql(updates: int, subsets: int, beta: float) -> str:
    steps = []
    for k in range(updates):
        part, zeta = f"view % {subsets} = {k % subsets}", 1 / (1 + 0.1 * ((k + 1) // subsets))
        steps.append(
            f"y{k} AS (SELECT image_id, z, view, t, sum(a * value) AS mean FROM x{k} JOIN m USING (y, x) WHERE {part} GROUP BY ALL), "
            f"b{k} AS (SELECT image_id, z, y, x, sum(a * (value / (mean + 0.1) - 1)) AS g FROM p JOIN y{k} USING (image_id, z, view, t) JOIN m USING (view, t) GROUP BY ALL), "
            f"d{k} AS (SELECT u.image_id, u.z, u.y, u.x, sum(w * ({_KAPPA.format('u')}) * ({_KAPPA.format('o')}) * (u.value - o.value)) AS s FROM x{k} u, near, x{k} o WHERE o.image_id = u.image_id AND o.z = u.z + dz AND o.y = u.y + dy AND o.x = u.x + dx GROUP BY ALL), "
            f"x{k + 1} AS (SELECT image_id, z, y, x, least(1e6, greatest(0, value + {zeta} * ({subsets} * g - {beta} * s) / d)) AS value FROM x{k} JOIN b{k} USING (image_id, z, y, x) JOIN d{k} USING (image_id, z, y, x) JOIN den USING (image_id, z, y, x))"
        )
    return (
        f"WITH {_DATA}, {_NEAR}, {_PAIR}, o AS (SELECT view, t, sum(a) AS ones FROM m GROUP BY ALL), c AS (SELECT image_id, z, y, x, sum(k) AS c FROM pair GROUP BY ALL), "
        f"e AS (SELECT image_id, z, y, x, sum(a * ones / value) AS d FROM p JOIN o USING (view, t) JOIN m USING (view, t) GROUP BY ALL), den AS (SELECT image_id, z, y, x, d + {2 * beta} * c AS d FROM e JOIN c USING (image_id, z, y, x)), "
        f"x0 AS (SELECT image_id, z, y, x, 1.0::DOUBLE AS value FROM img), {', '.join(steps)} SELECT * FROM x{updates}"
    )


@_query(_ossps_sql(3, 2, 0.2))
def penalised_ossps(spark, sf_dir):
    m, data, start = _phantom(spark, sf_dir)
    return penalised.ossps(m, data, start, "image_id", 2, 3, 0.2, _kappa(start), background=0.1)


_KERNEL = """box AS (SELECT dz, dy, dx FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx)), sd AS (SELECT image_id, stddev_samp(value) AS sd FROM img GROUP BY 1),
k0 AS (SELECT i.image_id, i.z, i.y, i.x, o.z AS oz, o.y AS oy, o.x AS ox, exp(-(((i.value - o.value) / sd) ** 2 + (dz * dz + dy * dy + dx * dx) / 2.0)) AS k FROM img i JOIN sd USING (image_id), box, img o WHERE o.image_id = i.image_id AND o.z = i.z + dz AND o.y = i.y + dy AND o.x = i.x + dx),
ker AS (SELECT * REPLACE (k / sum(k) OVER (PARTITION BY image_id, z, y, x) AS k) FROM k0)"""


def _kernel_sql(updates: int, subsets: int) -> str:
    steps = []
    through = lambda name, of, col: f"{name} AS (SELECT n.image_id, n.z, n.y, n.x, sum(k * q.{col}) AS {col} FROM ker n JOIN {of} q ON q.image_id = n.image_id AND q.z = n.oz AND q.y = n.oy AND q.x = n.ox GROUP BY 1, 2, 3, 4)"
    for k in range(updates):
        part = f"view % {subsets} = {k % subsets}"
        steps += [
            through(f"i{k}", f"x{k}", "value"),
            f"y{k} AS (SELECT image_id, z, view, t, sum(a * value) AS mean FROM i{k} JOIN m USING (y, x) WHERE {part} GROUP BY ALL)",
            f"b{k} AS (SELECT image_id, z, y, x, sum(a * value / mean) AS g FROM p JOIN y{k} USING (image_id, z, view, t) JOIN m USING (view, t) GROUP BY ALL)",
            f"u{k} AS (SELECT image_id, z, y, x, sum(a) AS s FROM img JOIN m USING (y, x) WHERE {part} GROUP BY ALL)",
            through(f"g{k}", f"b{k}", "g"),
            through(f"s{k}", f"u{k}", "s"),
            f"x{k + 1} AS (SELECT image_id, z, y, x, value * g / s AS value FROM x{k} JOIN g{k} USING (image_id, z, y, x) JOIN s{k} USING (image_id, z, y, x))",
        ]
    return f"WITH {_DATA}, {_KERNEL}, x0 AS (SELECT image_id, z, y, x, 1.0::DOUBLE AS value FROM img), {', '.join(steps)}, {through('last', f'x{updates}', 'value')} SELECT * FROM last"


@_query(_kernel_sql(2, 2))
def kernel_em(spark, sf_dir):
    m, data, start = _phantom(spark, sf_dir)
    kernel = penalised.kernel_matrix(tables.images(spark, sf_dir), ["image_id"])
    return penalised.kernel_em(m, data, start, kernel, "image_id", 2, 2)


@_query(f"""WITH {_IMG}, {_REC}, {_ray_sql(12, 12, 8, 1.0)}, i AS (SELECT z, y, x, avg(value) AS value FROM img GROUP BY ALL), e AS (SELECT ring AS z, d1 % 12 AS view, d2 % 12 AS t, count(*) AS n FROM rec WHERE is_prompt GROUP BY ALL),
y AS (SELECT z, view, t, sum(a * value) AS mean FROM i JOIN ray USING (y, x) GROUP BY ALL), b AS (SELECT z, y, x, sum(a * n / (mean + 0.5)) AS g FROM e JOIN y USING (z, view, t) JOIN ray USING (view, t) GROUP BY ALL), s AS (SELECT y, x, sum(a) AS s FROM ray GROUP BY ALL)
SELECT z, y, x, coalesce(g, 0) - s AS gradient FROM i JOIN s USING (y, x) LEFT JOIN b USING (z, y, x)""")
def listmode_gradient(spark, sf_dir):
    image = tables.images(spark, sf_dir).groupBy("z", "y", "x").agg(F.avg("value").alias("value"))
    events = tables.records(spark, sf_dir).filter("is_prompt").select(F.col("ring").alias("z"), F.expr("d1 % 12").alias("view"), F.expr("d2 % 12").alias("t"))
    return penalised.listmode_gradient(raytrace.ray_matrix(spark, 12, 12, 8), events, image, ["z"], 0.5)


@_query(f"WITH {_IMG} SELECT image_id, z, y, x, value * 2.5 * ln(2) / 6584.04 * CASE z WHEN 0 THEN 600 ELSE 1800 END / (2 ** (-CASE z WHEN 0 THEN 0 ELSE 600 + 1800 * (z - 1) END / 6584.04) - 2 ** (-CASE z WHEN 0 THEN 600 ELSE 600 + 1800 * z END / 6584.04)) AS value FROM img")
def calibrated_frames(spark, sf_dir):
    """Planes taken for frames: ten minutes, then seven of half an hour."""
    times = [(0.0, 600.0), *((600.0 + 1800 * k, 2400.0 + 1800 * k) for k in range(7))]
    images = tables.images(spark, sf_dir).withColumn("frame", F.col("z") + 1)
    return frames.calibrated(images, times, 6584.04, 2.5).drop("frame")


@_query(f"WITH {_BINS} SELECT * FROM proj WHERE abs(segment) <= 1")
def restricted_segments(spark, sf_dir):
    return frames.restricted(tables.projdata(spark, sf_dir), 1)


@_query(f"WITH {_BINS}, o AS (SELECT j::INT AS j FROM range(-20, 21) r(j)), e AS (SELECT *, 100 * sin((tang - 0.5) * pi() / 64) AS lo, 100 * sin((tang + 0.5) * pi() / 64) AS hi FROM proj) "
        "SELECT segment, view, axial, j AS tang, sum(value * (least(hi, (j + 0.5) * 4) - greatest(lo, (j - 0.5) * 4)) / 4) AS value FROM e JOIN o ON hi > (j - 0.5) * 4 AND lo < (j + 0.5) * 4 GROUP BY ALL")
def arc_corrected(spark, sf_dir):
    return frames.arc_corrected(tables.projdata(spark, sf_dir), ["segment", "view", "axial"], SINGLE, range(-8, 8), 4.0)


_PAIRS = "pd AS (SELECT segment, axial, ((view + (tang >> 1) + 64) % 64)::INT AS d1, ((view - ((tang + 1) >> 1) + 32 + 64) % 64)::INT AS d2, (axial + greatest(0, -segment))::INT AS ring1, (axial + greatest(0, segment))::INT AS ring2, value FROM proj WHERE axial + abs(segment) < 8)"


@_query(f"WITH {_BINS}, {_PAIRS} SELECT d1, ring1, d2, ring2, value FROM pd")
def detector_pair_data(spark, sf_dir):
    return frames.detector_pair_data(tables.projdata(spark, sf_dir), SINGLE)


@_query(f"WITH {_BINS}, {_PAIRS} SELECT ring, det, sum(value) AS value FROM (SELECT ring1 AS ring, d1 AS det, value FROM pd UNION ALL SELECT ring2, d2, value FROM pd) GROUP BY ALL")
def fan_sums_of_projdata(spark, sf_dir):
    return frames.fan_sums(tables.projdata(spark, sf_dir), SINGLE)


@_query(f"WITH {_IMG}, {_ray_sql(12, 12, 8, 1.0)} SELECT image_id, z, view, t, exp(0.1 * sum(a * value)) AS value FROM img JOIN ray USING (y, x) GROUP BY ALL")
def attenuation_factors(spark, sf_dir):
    return frames.attenuation_factors(raytrace.ray_matrix(spark, 12, 12, 8), tables.images(spark, sf_dir), ["image_id", "z"])


@_query(f"WITH {_REC} SELECT ring, count(*) AS records, count(*) FILTER (is_prompt) AS prompts, count(*) FILTER (NOT is_prompt) AS delayeds, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM rec GROUP BY 1")
def listmode_summary(spark, sf_dir):
    return frames.summary(tables.records(spark, sf_dir), ["ring"])


_CYCLES = "c AS (SELECT ring, k * 40000000 + ring * 1000000 AS a, k * 40000000 + ring * 1000000 + 30000000 + 1000000 * (k % 10) AS b FROM range(8) r(ring), range(60) q(k))"


@_query(f"WITH {_REC}, {_CYCLES} SELECT ring, (floor((time_ms - a) * 4 / (b - a)) + 1)::INT AS gate, count(*) AS n FROM rec JOIN c USING (ring) WHERE time_ms >= a AND time_ms < b GROUP BY ALL")
def gated_counts(spark, sf_dir):
    """Cycles of 30,000 to 39,000 s, four gates in each."""
    k, ring = F.floor(F.col("id") / 8), F.pmod("id", F.lit(8))
    begin = k * 40_000_000 + ring * 1_000_000
    cycles = spark.range(480).select(ring.cast("int").alias("ring"), begin.alias("start_ms"), (begin + 30_000_000 + 1_000_000 * F.pmod(k, F.lit(10))).alias("end_ms"))
    return frames.gated_counts(tables.records(spark, sf_dir), cycles, 4, ["ring"])


@_query(f"""WITH {_IMG}, f AS (SELECT image_id, z, y, x, x + 0.25 * (image_id % 3) AS ax FROM img), k AS (SELECT f.*, floor(ax)::INT + i AS sx, CASE WHEN i = 1 THEN ax - floor(ax) ELSE 1 - ax + floor(ax) END AS w FROM f, range(2) q(i))
SELECT k.image_id // 3 AS subject, k.z, k.y, k.x, sum(w * coalesce(img.value, 0)) AS value FROM k LEFT JOIN img ON img.image_id = k.image_id AND img.z = k.z AND img.y = k.y AND img.x = k.sx GROUP BY ALL""")
def gates_moved_and_added(spark, sf_dir):
    """Three images a subject are its gates, each moved by a field of its own and added up."""
    image = tables.images(spark, sf_dir)
    field = image.select(*VOXEL, F.lit(0.0).alias("dz"), F.lit(0.0).alias("dy"), (0.25 * F.pmod("image_id", F.lit(3))).alias("dx"))
    moved = analysis.displaced(image, field, ["image_id"])
    return moved.groupBy(F.floor(F.col("image_id") / 3).alias("subject"), "z", "y", "x").agg(F.sum("value").alias("value"))


@_query(f"WITH {_BINS}, o AS (SELECT j::INT AS j, (j - 0.5) / 0.5 AS lo, (j + 0.5) / 0.5 AS hi FROM range(8) r(j)) SELECT segment, view, axial, j AS tang, sum(value * (least(hi, tang + 8.5) - greatest(lo, tang + 7.5))) AS value FROM proj JOIN o ON hi > tang + 7.5 AND lo < tang + 8.5 GROUP BY ALL")
def zoomed_viewgrams(spark, sf_dir):
    rows = tables.projdata(spark, sf_dir).withColumn("tang", F.col("tang") + 8)
    return resample.overlap_interpolate(rows, BIN[:3], "tang", resample.overlap_weights(16, 8, 0.5))


@_query("SELECT o_orderkey, date_diff('second', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE + 3723.25 - 3600 AS seconds FROM orders")
def dicom_times(spark, sf_dir):
    """Date and time strings with an offset, read as seconds since 1970."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("010203.25+0100"))
    rows = tables.load(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"))
    return rows.select("o_orderkey", scalar.seconds_of_stamp(F.col("stamp")).alias("seconds"))


@_query()
def events_bootstrapped(spark, sf_dir):
    return frames.bootstrap(tables.records(spark, sf_dir), ["ring"])


@_query()
def metz_filter(spark, sf_dir):
    kernel = penalised.metz_kernel(2.0, 1.0, 3)
    return stencil.separable(tables.images(spark, sf_dir), ["image_id"], {a: kernel for a in "zyx"})
