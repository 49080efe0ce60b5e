"""The registered queries of the tomographic operators on the driver's tables, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoflow.functions import scalar
from sinoflow.operators import correct, listmode, rebin, recon, reduce, resample, stencil
from sinoflow.sources import tables
from sinoflow.sources.tables import BIN

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

_BINS = """bins AS (SELECT (l_suppkey % 5 - 2)::INT AS segment, (l_partkey % 16)::INT AS view, (l_orderkey % 8)::INT AS axial, ((l_partkey + l_linenumber) % 16 - 8)::INT AS tang,
 l_quantity AS value, l_discount AS weight FROM lineitem),
proj AS (SELECT segment, view, axial, tang, sum(value) AS value FROM bins GROUP BY ALL)"""
_IMG = """img0 AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
img AS (SELECT vec_id // 8 AS image_id, (vec_id % 8)::INT AS z, (i // 8)::INT AS y, (i % 8)::INT AS x, abs(v) AS value FROM img0)"""
_REC = """rec AS (SELECT event_id AS rec_no, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000)::BIGINT AS time_ms, event_type <> 'error' AS is_prompt, event_type AS kind,
 (user_id % 64)::INT AS d1, ((user_id * 7 + event_id) % 64)::INT AS d2, (event_id % 8)::INT AS ring FROM events)"""
_MATRIX = """m AS (SELECT v AS view, CASE v WHEN 0 THEN x WHEN 1 THEN x + y WHEN 2 THEN y ELSE x - y + 7 END AS t, y, x, CASE WHEN v % 2 = 0 THEN 1.0 ELSE sqrt(2) END::DOUBLE AS a
 FROM range(4) r(v), range(8) p(y), range(8) q(x))"""
_NEAR = """near AS (SELECT dz, dy, dx, 1 / sqrt(dz * dz + dy * dy + dx * dx) AS w FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE dz <> 0 OR dy <> 0 OR dx <> 0),
pair AS (SELECT s.image_id, s.z, s.y, s.x, s.value AS a, t.value AS b, w FROM img s, near n, img t WHERE t.image_id = s.image_id AND t.z = s.z + dz AND t.y = s.y + dy AND t.x = s.x + dx)"""


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


FRAMES = [(0.0, 86_400.0), (86_400.0, 604_800.0), (700_000.0, 2_000_000.0)]
_FOLD = """fold AS (SELECT *, (d1 - d2 + 96) % 64 AS t, (d1 - (((d1 - d2 + 96) % 64) >> 1) + 64) % 64 AS v FROM rec),
det AS (SELECT *, v % 32 AS view, CASE WHEN v < 32 AND t < 32 THEN t WHEN v < 32 THEN 64 - t WHEN t < 32 THEN -t ELSE t - 64 END AS tang, (v < 32) <> (t < 32) AS swapped,
 CASE WHEN time_ms / 1000.0 < 86400 THEN 1 WHEN time_ms / 1000.0 < 604800 THEN 2 WHEN time_ms / 1000.0 >= 700000 AND time_ms / 1000.0 < 2000000 THEN 3 END AS frame FROM fold)"""


@_query(f"WITH {_REC}, {_FOLD} SELECT frame, ring, view, tang, sum(CASE WHEN is_prompt THEN 1 ELSE -1 END) AS value FROM det WHERE frame IS NOT NULL GROUP BY ALL")
def listmode_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listmode.bin_events(tables.records(spark, sf_dir), 64, FRAMES)


@_query(f"WITH {_REC}, {_FOLD} SELECT frame, ring, view, tang, count(*) AS value FROM det WHERE frame IS NOT NULL AND is_prompt AND abs(tang) <= 10 GROUP BY ALL")
def listmode_prompts_only(spark, sf_dir):
    return listmode.bin_events(tables.records(spark, sf_dir), 64, FRAMES, delayed=0, max_tang=10)


@_query(f"WITH {_REC}, {_FOLD} SELECT rec_no, view, tang, swapped FROM det")
def detector_pairs_to_bins(spark, sf_dir):
    view, tang, swapped = scalar.view_of_detectors(F.col("d1"), F.col("d2"), 64)
    return tables.records(spark, sf_dir).select("rec_no", view.alias("view"), tang.alias("tang"), swapped.alias("swapped"))


@_query(f"WITH {_REC}, {_FOLD}, u AS (SELECT DISTINCT view, tang FROM det WHERE abs(tang) < 32) SELECT view, tang, (view + (tang >> 1) + 64) % 64 AS d1, (view - ((tang + 1) >> 1) + 32 + 64) % 64 AS d2 FROM u")
def bins_to_detector_pairs(spark, sf_dir):
    view, tang, _ = scalar.view_of_detectors(F.col("d1"), F.col("d2"), 64)
    used = tables.records(spark, sf_dir).select(view.alias("view"), tang.alias("tang")).distinct().filter(F.abs("tang") < 32)
    d1, d2 = scalar.detectors_of_view(F.col("view"), F.col("tang"), 64)
    return used.select("view", "tang", d1.alias("d1"), d2.alias("d2"))


@_query(
    f"WITH {_REC} SELECT rec_no, ring, is_prompt, coalesce(last_value(CASE WHEN kind = 'click' THEN time_ms END IGNORE NULLS) OVER (PARTITION BY ring ORDER BY rec_no ROWS UNBOUNDED PRECEDING), 0) AS time_ms FROM rec"
)
def last_time_tick(spark, sf_dir):
    rows = tables.records(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "click", "time").otherwise("event"))
    return listmode.carry_time(rows, ["ring"]).select("rec_no", "ring", "is_prompt", "time_ms")


@_query(
    f"""WITH {_REC}, n AS (SELECT *, sum(CASE WHEN is_prompt THEN 1 ELSE -1 END) OVER (PARTITION BY ring ORDER BY rec_no) AS net FROM rec),
b AS (SELECT *, max(net) OVER (PARTITION BY ring ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n) SELECT rec_no, ring, is_prompt FROM b WHERE before IS NULL OR before < 100"""
)
def until_net_counts(spark, sf_dir):
    return listmode.until_net_counts(tables.records(spark, sf_dir), 100, ["ring"]).select("rec_no", "ring", "is_prompt")


@_query(f"WITH {_REC} SELECT floor(time_ms / 3600000.0)::BIGINT AS slot, count(*) FILTER (is_prompt) AS prompts, count(*) FILTER (NOT is_prompt) AS delayeds FROM rec GROUP BY 1")
def count_rates(spark, sf_dir):
    return listmode.count_rates(tables.records(spark, sf_dir), 3600.0)


@_query(f"WITH {_REC} SELECT ring, det, count(*) AS n FROM (SELECT ring, unnest([d1, d2]) AS det FROM rec WHERE is_prompt) GROUP BY ALL")
def fan_sums(spark, sf_dir):
    return listmode.fan_sums(tables.records(spark, sf_dir))


@_query(
    f"""WITH {_REC}, s AS (SELECT ring AS unit, time_ms // 7200000 AS k, count(*) AS n FROM rec GROUP BY ALL), t AS (SELECT unit, k * 7200.0 AS a, (k + 1) * 7200.0 AS b, n FROM s),
r AS (SELECT unit, a, b, n, unnest(range(floor(a / 10000)::BIGINT, ceil(b / 10000)::BIGINT)) * 10000.0 AS c FROM t) SELECT unit, c::DOUBLE AS slice_s, sum(n * (least(b, c + 10000) - greatest(a, c)) / (b - a))::DOUBLE AS n FROM r GROUP BY 1, 2"""
)
def singles_rebinned(spark, sf_dir):
    slot = F.floor(F.col("time_ms") / 7_200_000)
    slices = tables.records(spark, sf_dir).groupBy(F.col("ring").alias("unit"), slot.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    slices = slices.select("unit", (F.col("k") * 7200.0).alias("start_s"), ((F.col("k") + 1) * 7200.0).alias("end_s"), "n")
    return listmode.singles_rebin(slices, 10_000.0)


@_query(f"WITH {_BINS} SELECT segment, view, axial, tang, 2 + 3 * greatest(10, least(1000, value)) ** 1.5 AS value FROM proj")
def elementwise_chain(spark, sf_dir):
    return tables.projdata(spark, sf_dir).select(*BIN, scalar.pow_times_add(F.col("value"), 1.5, 3.0, 2.0, 10.0, 1000.0).alias("value"))


@_query(f"WITH {_BINS}, w AS (SELECT segment, view, axial, tang, sum(weight) AS w FROM bins GROUP BY ALL) SELECT segment, view, axial, tang, CASE WHEN abs(w) <= 0.05 AND abs(value) <= 0.05 THEN 0 WHEN w = 0 THEN NULL ELSE value / w END AS ratio, CASE WHEN value < 100 THEN 0.0 ELSE 1.0 END::DOUBLE AS mask FROM proj JOIN w USING (segment, view, axial, tang)")
def guarded_quotient(spark, sf_dir):
    sums = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("value"), F.sum("weight").alias("w"))
    # floating sums of zeros are exactly zero
    return sums.select(*BIN, scalar.safe_divide(F.col("value"), F.col("w"), 0.05).alias("ratio"), scalar.binary_mask(F.col("value"), 100.0).alias("mask"))


@_query(
    "SELECT p_partkey, CASE WHEN abs(l * s) < 0.01 THEN exp(l * p_size * 10) ELSE l * s / (exp(-l * p_size * 10) - exp(-l * (p_size * 10 + s))) END AS factor, CASE WHEN p_retailprice - 1200 < 0 THEN greatest(0, 0.096 + 9.6e-5 * (p_retailprice - 1200)) ELSE 0.096 + 5.1e-5 * (p_retailprice - 1200) END AS mu "
    "FROM (SELECT *, ln(2) / 6586.2 AS l, p_retailprice / 10 AS s FROM part)"
)
def decay_and_attenuation(spark, sf_dir):
    p = tables.load(spark, sf_dir, "part")
    start = F.col("p_size") * 10
    return p.select(
        "p_partkey", scalar.decay_factor(start, start + F.col("p_retailprice") / 10, 6586.2).alias("factor"), scalar.hounsfield_to_mu(F.col("p_retailprice") - 1200, 0.096, 9.6e-5, 0.096, 5.1e-5, 0.0).alias("mu")
    )


@_query(f"WITH {_BINS} SELECT segment, sum(value) AS sum, sum(greatest(value, 0)) AS sum_positive, min(value) AS min, max(value) AS max, sum(value * value) AS norm_squared, sqrt(sum(value * value)) AS norm, min(value) FILTER (value > 0) AS min_positive FROM proj GROUP BY segment")
def projdata_statistics(spark, sf_dir):
    return reduce.statistics(tables.projdata(spark, sf_dir), by=["segment"])


@_query(f"WITH {_IMG} SELECT image_id, sum(z * value) * 2 / sum(value) AS cz, sum(y * value) * 3 / sum(value) AS cy, sum(x * value) * 3 / sum(value) AS cx FROM img GROUP BY 1")
def centre_of_gravity(spark, sf_dir):
    return reduce.centre_of_gravity(tables.images(spark, sf_dir), ["image_id"], (2.0, 3.0, 3.0))


@_query(f"WITH {_IMG} SELECT image_id, z, y, x, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY value DESC, z, y, x) AS k FROM img) WHERE k = 1")
def index_at_maximum(spark, sf_dir):
    return reduce.index_at_maximum(tables.images(spark, sf_dir), ["image_id"])


@_query(
    f"""WITH {_IMG}, s AS (SELECT image_id, z, count(*) * 2.0::DOUBLE AS volume, sum(value) * 2 AS integral, sum(value * value) * 2 AS square, min(value) AS min, max(value) AS max FROM img WHERE (y - 3.5) ** 2 + (x - 3.5) ** 2 <= 9 GROUP BY 1, 2),
v AS (SELECT *, integral / volume AS mean, square / volume - (integral / volume) ** 2 AS var FROM s) SELECT image_id, z, volume, integral, square, min, max, mean, sqrt(CASE WHEN var < 1e-4 * mean * mean THEN 0 ELSE var END) AS std FROM v"""
)
def roi_per_plane(spark, sf_dir):
    inside = ((F.col("y") - 3.5) * (F.col("y") - 3.5) + (F.col("x") - 3.5) * (F.col("x") - 3.5) <= 9).cast("double")
    return reduce.roi_values(tables.images(spark, sf_dir), inside, ["image_id"], 2.0, per_plane=True)


_LINE = """WITH s AS (SELECT l_suppkey, sum(w) AS s, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem) GROUP BY 1),
t AS (SELECT *, sxx - sx*sx/s AS stt, sxy - sx*sy/s AS sty FROM s WHERE s > 0 AND sxx - sx*sx/s > 0)
SELECT l_suppkey, sty/stt AS slope, (sy - sx*sty/stt)/s AS intercept, 1/stt AS var_slope, (1 + sx*sx/(s*stt))/s AS var_intercept, -sx/(s*stt) AS covariance FROM t"""


@_query(_LINE)
def weighted_line_fit(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "lineitem")
    # chi square, a difference of large sums, is tested on a small case
    return reduce.weighted_line(rows, ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice"), 1 + F.col("l_tax")).drop("chi_square")


@_query(
    """WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) / 86400000000.0 AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), l AS (SELECT *, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS t2, lead(v) OVER (PARTITION BY o_custkey ORDER BY t) AS v2 FROM o)
SELECT o_custkey, coalesce(sum((t2 - t) * (v2 + v) / 2), 0) AS integral FROM l GROUP BY 1"""
)
def trapezoid_integral(spark, sf_dir):
    o = tables.load(spark, sf_dir, "orders").groupBy("o_custkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000.0).alias("t")).agg(F.sum("o_totalprice").alias("v"))
    return reduce.trapezoid(o, ["o_custkey"], "t", "v")


@_query(f"WITH {_BINS} SELECT a.segment, max(abs(a.value - b.v)) AS difference, max(abs(a.value - b.v)) / max(abs(a.value)) AS relative FROM proj a JOIN (SELECT segment, view, axial, tang, sum(value * (1 - weight)) AS v FROM bins GROUP BY ALL) b USING (segment, view, axial, tang) GROUP BY 1")
def compare_projdata(spark, sf_dir):
    other = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum(F.col("value") * (1 - F.col("weight"))).alias("value"))
    return reduce.compare(tables.projdata(spark, sf_dir), other, BIN, ["segment"])


@_query(
    f"""WITH {_BINS}, g AS (SELECT s AS segment, a AS axial, floor((s + 1) / 3.0)::INT AS o, 2 * a - (7 - abs(s)) AS m FROM range(-2, 3) x(s), range(8) y(a) WHERE a < 8 - abs(s)),
k AS (SELECT *, dense_rank() OVER (PARTITION BY o ORDER BY m) - 1 AS oa, count(*) OVER (PARTITION BY o, m) AS n FROM g)
SELECT o::INT AS segment, (view // 2)::INT AS view, oa::INT AS axial, tang, sum(value) / any_value(n * 2) AS value FROM bins JOIN k USING (segment, axial) WHERE abs(tang) <= 6 GROUP BY o, view // 2, oa, tang"""
)
def ssrb(spark, sf_dir):
    return rebin.ssrb(tables.bins(spark, sf_dir), {s: 8 - abs(s) for s in range(-2, 3)}, 3, 2, 6)


@_query(f"WITH {_BINS} SELECT axial, tang, sum(value) AS value FROM bins GROUP BY 1, 2")
def sum_over_views(spark, sf_dir):
    return rebin.project_axis(tables.bins(spark, sf_dir), ["axial", "tang"])


_FACTORS = """q AS (SELECT segment, axial, view, tang, sum(value) AS n, sum(value * (1 - weight)) AS d, max(weight) AS w FROM bins GROUP BY ALL), f AS (SELECT segment, axial, CASE WHEN sum(d * w) = 0 THEN 1 ELSE sum(n * w) / sum(d * w) END AS factor FROM q GROUP BY ALL)"""


@_query(f"WITH {_BINS}, {_FACTORS} SELECT segment, view, axial, tang, value * factor AS value FROM proj JOIN f USING (segment, axial)")
def scaled_sinograms(spark, sf_dir):
    q = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("value"), F.sum(F.col("value") * (1 - F.col("weight"))).alias("d"), F.max("weight").alias("weight"))
    factors = rebin.scale_factors(q.select(*BIN, "value", "weight"), q.select(*BIN, F.col("d").alias("value")), BIN, ["segment", "axial"])
    return rebin.apply_factors(q.select(*BIN, "value"), F.broadcast(factors), ["segment", "axial"])  # a row a sinogram


@_query(f"WITH {_BINS} SELECT segment, view, axial, tang, value FROM proj UNION ALL SELECT segment, view + 16, axial, -tang, value FROM proj WHERE view < 2 UNION ALL SELECT segment, view - 16, axial, -tang, value FROM proj WHERE view >= 14")
def extended_segments(spark, sf_dir):
    return rebin.extend_segment(tables.projdata(spark, sf_dir), 16, 2)


@_query(f"WITH {_BINS}, b AS (SELECT segment, view, axial, tang, round((weight * 100 - 5) / 3)::INT AS tof, value FROM (SELECT segment, view, axial, tang, value, round(weight * 100) / 100 AS weight FROM bins)) SELECT segment, view, axial, tang, tof, sum(value) AS value FROM b GROUP BY ALL")
def tof_mashed(spark, sf_dir):
    rows = tables.bins(spark, sf_dir).withColumn("tof", (F.round(F.col("weight") * 100) - 5).cast("int"))
    return rebin.tof_mash(rows, 3)


@_query(f"WITH {_IMG}, {_MATRIX} SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL")
def forward_projection(spark, sf_dir):
    return recon.forward(recon.parallel_matrix(spark, 8), tables.images(spark, sf_dir), ["image_id", "z"])


@_query(f"WITH {_IMG}, {_MATRIX}, p AS (SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL) SELECT image_id, z, y, x, sum(a * value) AS value FROM p JOIN m USING (view, t) GROUP BY ALL")
def back_projection(spark, sf_dir):
    m = recon.parallel_matrix(spark, 8)
    return recon.backward(m, recon.forward(m, tables.images(spark, sf_dir), ["image_id", "z"]), ["image_id", "z"])


def _osem_sql(updates: int, subsets: int) -> str:
    steps = []
    for k in range(updates):
        part = f"view % {subsets} = {k % subsets}"
        steps.append(
            f"y{k} AS (SELECT image_id, z, view, t, sum(a * value) AS mean FROM x{k} JOIN m USING (y, x) WHERE {part} GROUP BY ALL), "
            f"r{k} AS (SELECT image_id, z, view, t, CASE WHEN abs(mean + 0.1) <= 1e-10 AND abs(value) <= 1e-10 THEN 0 ELSE value / (mean + 0.1) END AS q FROM p JOIN y{k} USING (image_id, z, view, t)), "
            f"b{k} AS (SELECT image_id, z, y, x, sum(a * q) AS g FROM r{k} JOIN m USING (view, t) GROUP BY ALL), s{k} AS (SELECT y, x, sum(a) AS s FROM m WHERE {part} GROUP BY ALL), "
            f"x{k + 1} AS (SELECT image_id, z, y, x, value * g / s AS value FROM x{k} JOIN b{k} USING (image_id, z, y, x) JOIN s{k} USING (y, x))"
        )
    return f"WITH {_IMG}, {_MATRIX}, p AS (SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL), x0 AS (SELECT image_id, z, y, x, 1.0::DOUBLE AS value FROM img), {', '.join(steps)} SELECT * FROM x{updates}"


@_query(_osem_sql(4, 2))
def osem(spark, sf_dir):
    m, image = recon.parallel_matrix(spark, 8), tables.images(spark, sf_dir)
    data = recon.forward(m, image, ["image_id", "z"])
    return recon.osem(m, data, image.withColumn("value", F.lit(1.0)), ["image_id", "z"], 2, 4, 0.1)


@_query(
    f"""WITH {_IMG}, {_MATRIX}, p AS (SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL), o AS (SELECT view, t, sum(a) + 0.5 AS mean FROM m GROUP BY ALL),
l AS (SELECT image_id, value AS q, greatest(mean, value / 10000) AS mean, max(value) OVER (PARTITION BY image_id, z, view) * 1e-6 AS small FROM p JOIN o USING (view, t)) SELECT image_id, sum(CASE WHEN q <= small THEN -mean ELSE q * ln(mean) - mean END) AS log_likelihood FROM l GROUP BY 1"""
)
def poisson_log_likelihood(spark, sf_dir):
    m, image = recon.parallel_matrix(spark, 8), tables.images(spark, sf_dir)
    planes = recon.log_likelihood(m, recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0)), ["image_id", "z"], 0.5)
    return planes.groupBy("image_id").agg(F.sum("log_likelihood").alias("log_likelihood"))


_G = stencil.gaussian_kernel(1.5)


@_query(
    f"WITH {_IMG}, k AS (SELECT i - {len(_G) // 2} AS d, ({_G})[i + 1] AS w FROM range({len(_G)}) q(i)), "
    "g1 AS (SELECT image_id, z, y, x + d AS x, sum(w * value) AS value FROM img, k WHERE x + d BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4) SELECT image_id, z, y + d AS y, x, sum(w * value) AS value FROM g1, k WHERE y + d BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4"
)
def gaussian_filter(spark, sf_dir):
    return stencil.separable(tables.images(spark, sf_dir), ["image_id"], {"x": _G, "y": _G})


_BOX = "box AS (SELECT s.image_id, s.z, s.y, s.x, t.value FROM img s JOIN img t ON t.image_id = s.image_id AND t.z BETWEEN s.z - 1 AND s.z + 1 AND t.y BETWEEN s.y - 1 AND s.y + 1 AND t.x BETWEEN s.x - 1 AND s.x + 1)"


@_query(f"WITH {_IMG}, {_BOX} SELECT image_id, z, y, x, median(value) AS value FROM box GROUP BY ALL")
def median_filter(spark, sf_dir):
    return stencil.rank_filter(tables.images(spark, sf_dir), ["image_id"], 1, "median")


@_query(f"WITH {_IMG}, {_BOX} SELECT image_id, z, y, x, min(value) AS value FROM box GROUP BY ALL")
def minimum_filter(spark, sf_dir):
    return stencil.rank_filter(tables.images(spark, sf_dir), ["image_id"], 1, "min")


@_query(f"WITH {_IMG}, {_BOX} SELECT image_id, z, y, x, max(value) AS value FROM box GROUP BY ALL")
def maximum_filter(spark, sf_dir):
    return stencil.rank_filter(tables.images(spark, sf_dir), ["image_id"], 1, "max")


@_query(f"WITH {_IMG}, {_NEAR} SELECT image_id, z, y, x, sum(w * (a - b) ** 2 / 4) AS prior, sum(w * (a - b)) AS gradient FROM pair GROUP BY ALL")
def quadratic_prior(spark, sf_dir):
    return stencil.prior(tables.images(spark, sf_dir), ["image_id"], "quadratic")


@_query(f"WITH {_IMG}, {_NEAR}, d AS (SELECT *, a + b + 2 * abs(a - b) AS den FROM pair) SELECT image_id, z, y, x, sum(CASE WHEN den = 0 THEN 0 ELSE w * (a - b) ** 2 / den / 2 END) AS prior, sum(CASE WHEN den = 0 THEN 0 ELSE w * (a - b) * (2 * abs(a - b) + a + 3 * b) / den ** 2 END) AS gradient FROM d GROUP BY ALL")
def relative_difference_prior(spark, sf_dir):
    return stencil.prior(tables.images(spark, sf_dir), ["image_id"], "relative_difference")


@_query(f"WITH {_IMG}, {_NEAR} SELECT image_id, z, y, x, sum(w * ln((exp(abs(2 * (a - b))) + exp(-abs(2 * (a - b)))) / 2) / 4) AS prior, sum(w * (exp(4 * (a - b)) - 1) / (exp(4 * (a - b)) + 1) / 2) AS gradient FROM pair GROUP BY ALL")
def logcosh_prior(spark, sf_dir):
    return stencil.prior(tables.images(spark, sf_dir), ["image_id"], "logcosh", scalar=2.0)


@_query(
    f"""WITH {_IMG}, a AS (SELECT *, min(value) OVER (PARTITION BY image_id, z) AS lo, max(value) OVER (PARTITION BY image_id, z) AS hi FROM img), b AS (SELECT *, (value - lo) / (hi - lo) AS s FROM a),
c AS (SELECT *, ln(0.25) / ln(avg(s) FILTER (abs(s) > 0.1) OVER (PARTITION BY image_id, z)) AS p FROM b) SELECT image_id, z, y, x, pow(s, p) * (hi - lo) + lo AS value FROM c"""
)
def gamma_filter(spark, sf_dir):
    return stencil.gamma_planes(tables.images(spark, sf_dir), ["image_id"])


@_query(f"WITH {_IMG} SELECT image_id, z, y, x, CASE WHEN (y - 3.5) ** 2 + (x - 3.5) ** 2 < 9 THEN value ELSE 0 END AS value FROM img")
def truncated_cylinder(spark, sf_dir):
    return stencil.truncate_cylinder(tables.images(spark, sf_dir), (3.5, 3.5), 3.0)


@_query(f"WITH {_IMG}, s AS (SELECT *, CASE WHEN value < 0.05 THEN 0 ELSE value END AS v FROM img) SELECT image_id, z, y, x, greatest(v, 0.01 * min(v) FILTER (v > 0) OVER (PARTITION BY image_id)) AS value FROM s")
def smallest_positive(spark, sf_dir):
    rows = tables.images(spark, sf_dir).withColumn("value", F.when(F.col("value") < 0.05, 0.0).otherwise(F.col("value")))
    return stencil.floor_at_smallest(rows, ["image_id"], 0.01)


def _zoom_sql() -> str:
    w = resample.overlap_weights(8, 4, 0.5)
    rows = ", ".join(f"({i}, {j}, {p!r})" for i, j, p in w)
    return f"WITH {_IMG}, k(i, j, w) AS (VALUES {rows}) SELECT image_id, a.j AS z, b.j AS y, c.j AS x, sum(value * a.w::DOUBLE * b.w::DOUBLE * c.w::DOUBLE) AS value FROM img JOIN k a ON a.i = z JOIN k b ON b.i = y JOIN k c ON c.i = x GROUP BY ALL"


@_query(_zoom_sql())
def zoomed_images(spark, sf_dir):
    return resample.zoom_image(tables.images(spark, sf_dir), ["image_id"], (8, 8, 8), (0.5, 0.5, 0.5))


@_query(f"WITH {_IMG} SELECT image_id, 7 - z AS z, y, x, value FROM img")
def inverted_axis(spark, sf_dir):
    return resample.invert_axis(tables.images(spark, sf_dir), "z", 8)


@_query(f"WITH {_IMG} SELECT image_id, z + 1 AS z, y, x + k AS x, sum(value * CASE WHEN k = 0 THEN 0.75 ELSE 0.25 END) AS value FROM img, range(2) q(k) WHERE z + 1 <= 7 AND x + k <= 7 GROUP BY 1, 2, 3, 4")
def warped_images(spark, sf_dir):
    return resample.warp(tables.images(spark, sf_dir), ["image_id"], (1.0, 0.0, 0.25), (8, 8, 8))


_EFF = "eff AS (SELECT l_suppkey % 64 AS det, 0.5 + avg(l_discount) AS eff FROM lineitem GROUP BY 1)"


@_query(f"WITH {_REC}, {_EFF}, h AS (SELECT d1, d2, count(*) AS value FROM rec WHERE is_prompt GROUP BY ALL) SELECT h.d1, h.d2, a.eff * b.eff AS eff, value / greatest(1e-20, a.eff * b.eff) AS value FROM h JOIN eff a ON a.det = d1 JOIN eff b ON b.det = d2")
def efficiency_normalisation(spark, sf_dir):
    eff = tables.load(spark, sf_dir, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(64)).alias("det")).agg((0.5 + F.avg("l_discount")).alias("eff"))
    pairs = tables.records(spark, sf_dir).filter("is_prompt").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("value"))
    return correct.normalise(correct.efficiencies(pairs, eff)).select("d1", "d2", "eff", "value")


@_query(f"WITH {_REC}, s AS (SELECT d1 AS det, count(*) / 1000.0::DOUBLE AS rate FROM rec GROUP BY 1) SELECT a.det AS d1, b.det AS d2, 2 * 0.006 * a.rate * b.rate AS value FROM s a JOIN s b ON a.det < b.det")
def randoms_from_singles(spark, sf_dir):
    singles = tables.records(spark, sf_dir).groupBy(F.col("d1").alias("det")).agg((F.count(F.lit(1)) / 1000.0).alias("rate"))
    return correct.randoms(singles, 0.006)


@_query(f"WITH {_BINS}, a AS (SELECT segment, view, axial, min(tang) FILTER (value >= 400) AS lo, max(tang) FILTER (value >= 400) AS hi FROM proj GROUP BY ALL) SELECT segment, view, axial, tang, CASE WHEN lo IS NULL OR tang < lo - 1 OR tang > hi + 1 THEN 1 ELSE 0 END AS mask FROM proj JOIN a USING (segment, view, axial)")
def tail_mask(spark, sf_dir):
    return correct.tail_mask(tables.projdata(spark, sf_dir), ["segment", "view", "axial"], 400.0, 1)


@_query(f"WITH {_BINS}, l AS (SELECT segment, view, axial, tang, ln(1 + value) / 10 AS li FROM proj) SELECT segment, view, axial, tang, value * exp(li) AS value FROM proj JOIN l USING (segment, view, axial, tang)")
def attenuation_correction(spark, sf_dir):
    p = tables.projdata(spark, sf_dir)
    return correct.attenuate(p, p.withColumn("value", F.log1p("value") / 10), BIN)


@_query(
    """SELECT i // 64 AS z, (i % 64) // 8 AS y, i % 8 AS x, avg(CASE WHEN ((i // 64 + a - 3.5) / 3) ** 2 + ((i % 64) // 8 + b - 3.5) ** 2 / 9 + (i % 8 + c - 3.5) ** 2 / 16 <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS value
FROM range(512) q(i), (VALUES (-0.25), (0.25)) r(a), (VALUES (-0.25), (0.25)) s(b), (VALUES (-0.25), (0.25)) t(c) GROUP BY 1, 2, 3"""
)
def rasterised_ellipsoid(spark, sf_dir):
    return correct.rasterise(spark, (8, 8, 8), "ellipsoid", (3.5, 3.5, 3.5), (3.0, 3.0, 4.0), 2)


@_query(
    f"WITH {_IMG}, mdl AS (SELECT f AS z, 100 * exp(-0.1 * f) + 5 AS plasma, 100 / 0.1 * (1 - exp(-0.1 * f)) + 5 * f AS integral FROM range(8) q(f)) "
    "SELECT image_id, y, x, regr_slope(value / plasma, integral / plasma) AS ki, regr_intercept(value / plasma, integral / plasma) AS vb FROM img JOIN mdl USING (z) GROUP BY ALL"
)
def patlak(spark, sf_dir):
    f = F.col("id")
    model = spark.range(8).select(f.cast("int").alias("frame"), (100 * F.exp(-0.1 * f) + 5).alias("plasma"), (100 / 0.1 * (1 - F.exp(-0.1 * f)) + 5 * f).alias("integral"))
    return correct.patlak(tables.images(spark, sf_dir).withColumnRenamed("z", "frame"), model, ["image_id", "y", "x"])


@_query(f"WITH {_BINS}, q AS (SELECT segment, view, axial, tang, sum(value) AS a, sum(value * (1 - weight)) AS b FROM bins GROUP BY ALL) SELECT segment, sum(CASE WHEN a <= 0 THEN b ELSE a * (ln(a) - ln(b)) + b - a END) AS kl FROM q GROUP BY 1")
def kl_divergence(spark, sf_dir):
    q = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("a"), F.sum(F.col("value") * (1 - F.col("weight"))).alias("b"))
    return q.groupBy("segment").agg(F.sum(scalar.kl_term(F.col("a"), F.col("b"))).alias("kl"))


flagship = listmode_binning


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


from sinoflow import catalog_geometry, catalog_penalised, catalog_recon  # noqa: E402, F401  they register their queries
