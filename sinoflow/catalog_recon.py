"""Registered queries of penalised reconstruction, normalisation, pre-correction and streaming, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sinoflow.catalog import _BINS, _FOLD, _IMG, _MATRIX, _REC, FRAMES, _query
from sinoflow.operators import correct, recon, stencil
from sinoflow.plans import job
from sinoflow.sources import tables
from sinoflow.sources.tables import BIN
from sinoflow.streaming import listmode as streamed

_NEAR = "near AS (SELECT dz, dy, dx, 1 / sqrt(dz * dz + dy * dy + dx * dx) AS w FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE dz <> 0 OR dy <> 0 OR dx <> 0)"
_DATA = f"{_IMG}, {_MATRIX}, p AS (SELECT image_id, z, view, t, sum(a * value) AS value FROM img JOIN m USING (y, x) GROUP BY ALL)"


def _phantom(spark, sf_dir):
    m, image = recon.parallel_matrix(spark, 8), tables.images(spark, sf_dir)
    return m, recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0))


def _map_sql(updates: int, subsets: int, beta: float, den: str) -> str:
    steps = []
    for k in range(updates):
        part = f"view % {subsets} = {k % subsets}"
        steps.append(
            f"y{k} AS (SELECT image_id, z, view, t, sum(a * value) AS mean FROM x{k} JOIN m USING (y, x) WHERE {part} GROUP BY ALL), r{k} AS (SELECT image_id, z, view, t, CASE WHEN abs(mean) <= 1e-10 AND abs(value) <= 1e-10 THEN 0 ELSE value / mean END AS q FROM p JOIN y{k} USING (image_id, z, view, t)), "
            f"b{k} AS (SELECT image_id, z, y, x, sum(a * q) AS g FROM r{k} JOIN m USING (view, t) GROUP BY ALL), s{k} AS (SELECT y, x, sum(a) AS s FROM m WHERE {part} GROUP BY ALL), "
            f"d{k} AS (SELECT u.image_id, u.z, u.y, u.x, {beta} * sum(w * (u.value - o.value)) AS d FROM x{k} u, near, x{k} o WHERE o.image_id = u.image_id AND o.z = u.z + dz AND o.y = u.y + dy AND o.x = u.x + dx GROUP BY ALL), "
            f"x{k + 1} AS (SELECT image_id, z, y, x, value * g / {den} AS value FROM x{k} JOIN b{k} USING (image_id, z, y, x) JOIN d{k} USING (image_id, z, y, x) JOIN s{k} USING (y, x))"
        )
    return f"WITH {_DATA}, {_NEAR}, x0 AS (SELECT image_id, z, y, x, 1.0::DOUBLE AS value FROM img), {', '.join(steps)} SELECT * FROM x{updates}"


@_query(_map_sql(3, 2, 0.2, "least(greatest(d / 2 + s, s / 10), s * 10)"))
def map_osl(spark, sf_dir):
    return recon.map_osl(*_phantom(spark, sf_dir), "image_id", 2, 3, 0.2)


@_query(_map_sql(2, 2, 0.2, "(greatest(0.1, least(10, 1 + d)) * s)"))
def map_osl_multiplicative(spark, sf_dir):
    return recon.map_osl(*_phantom(spark, sf_dir), "image_id", 2, 2, 0.2, multiplicative=True)


_JOB = """OSMAPOSLParameters :=
; penalised reconstruction declared as a parameter file
objective function type := PoissonLogLikelihoodWithLinearModelForMeanAndProjData
PoissonLogLikelihoodWithLinearModelForMeanAndProjData Parameters :=
prior type := quadratic
Quadratic Prior Parameters :=
penalisation factor := 0.2
END Quadratic Prior Parameters :=
end PoissonLogLikelihoodWithLinearModelForMeanAndProjData Parameters :=
number of subsets := 2
number of subiterations := 2
END :=
"""


@_query(_map_sql(2, 2, 0.2, "least(greatest(d / 2 + s, s / 10), s * 10)"))
def parameter_file_job(spark, sf_dir):
    return job.run(_JOB, *_phantom(spark, sf_dir))


def _ossps_sql(updates: int, subsets: int) -> str:
    steps = []
    for k in range(updates):
        part, zeta = f"view % {subsets} = {k % subsets}", 1 / (1 + 0.1 * ((k + 1) // subsets))
        steps.append(
            f"y{k} AS (SELECT image_id, z, view, t, sum(a * value) AS mean FROM x{k} JOIN m USING (y, x) WHERE {part} GROUP BY ALL), "
            f"b{k} AS (SELECT image_id, z, y, x, sum(a * (value / (mean + 0.1) - 1)) AS g FROM p JOIN y{k} USING (image_id, z, view, t) JOIN m USING (view, t) GROUP BY ALL), "
            f"x{k + 1} AS (SELECT image_id, z, y, x, least(1e6, greatest(0, value + {zeta * subsets} * g / d)) AS value FROM x{k} JOIN b{k} USING (image_id, z, y, x) JOIN den USING (image_id, z, y, x))"
        )
    return f"WITH {_DATA}, o AS (SELECT view, t, sum(a) AS ones FROM m GROUP BY ALL), den AS (SELECT image_id, z, y, x, sum(a * ones / value) AS d FROM p JOIN o USING (view, t) JOIN m USING (view, t) GROUP BY ALL), x0 AS (SELECT image_id, z, y, x, 1.0::DOUBLE AS value FROM img), {', '.join(steps)} SELECT * FROM x{updates}"


@_query(_ossps_sql(3, 2))
def ossps(spark, sf_dir):
    return recon.ossps(*_phantom(spark, sf_dir), ["image_id", "z"], 2, 3, background=0.1)


_RAMP = "CASE WHEN k = 0 THEN 0.25 WHEN k % 2 <> 0 THEN -1 / (pi() * k) ** 2 ELSE 0 END::DOUBLE"
_RAMPED = f"f AS (SELECT image_id, z, view, t + k AS t, sum(value * {_RAMP}) AS value FROM p, range(-14, 15) q(k) WHERE t + k BETWEEN 0 AND 14 GROUP BY 1, 2, 3, 4)"


@_query(f"WITH {_DATA}, {_RAMPED} SELECT * FROM f")
def ramp_filter(spark, sf_dir):
    return recon.ramp_filter(_phantom(spark, sf_dir)[1], ["image_id", "z", "view"], 15)


@_query(f"WITH {_DATA}, {_RAMPED} SELECT image_id, z, y, x, sum(a * value) * {math.pi / 4} AS value FROM f JOIN m USING (view, t) GROUP BY ALL")
def filtered_back_projection(spark, sf_dir):
    m, data, _ = _phantom(spark, sf_dir)
    return recon.fbp(m, data, ["image_id", "z"], 15, 4)


@_query(f"WITH {_MATRIX} SELECT y, x, sum(a * (1 + view) / 4) AS sens FROM m GROUP BY ALL")
def sensitivity_image(spark, sf_dir):
    m = recon.parallel_matrix(spark, 8)
    return recon.sensitivity(m, m.select("view", "t").distinct().withColumn("eff", (1 + F.col("view")) / 4))


@_query(f"WITH {_MATRIX} SELECT view % 3 AS subset, count(DISTINCT view) AS viewgrams FROM m GROUP BY 1")
def subset_balance(spark, sf_dir):
    return recon.subset_balance(recon.parallel_matrix(spark, 8), 3)


@_query(
    f"""WITH {_IMG}, l AS (SELECT s.image_id, s.z, s.y, s.x, s.value, count(*) AS k, avg(t.value) AS mean, avg(t.value * t.value) AS sq FROM img s JOIN img t ON t.image_id = s.image_id AND t.z = s.z AND abs(t.y - s.y) <= 1 AND abs(t.x - s.x) <= 1 GROUP BY ALL),
v AS (SELECT *, CASE WHEN k = 9 THEN sq - mean * mean ELSE 0 END AS var FROM l), n AS (SELECT *, avg(var) OVER (PARTITION BY image_id, z) AS noise FROM v)
SELECT image_id, z, y, x, CASE WHEN k < 9 THEN value ELSE coalesce((value - mean) / nullif(greatest(var, noise), 0) * greatest(var - noise, 0), 0) + mean END AS value FROM n"""
)
def wiener_filter(spark, sf_dir):
    return stencil.wiener_planes(tables.images(spark, sf_dir), ["image_id"])


@_query(
    f"""WITH {_IMG}, b AS (SELECT s.image_id, s.z, s.y, s.x, s.value, median(t.value) AS f FROM img s JOIN img t ON t.image_id = s.image_id AND abs(t.z - s.z) <= 1 AND abs(t.y - s.y) <= 1 AND abs(t.x - s.x) <= 1 GROUP BY ALL)
SELECT image_id, z, y, x, 0.5 * (CASE WHEN f = 0 THEN sign(value) * 1000 ELSE greatest(-1000, least(1000, value / f)) END - 1) AS gradient FROM b"""
)
def median_root_prior(spark, sf_dir):
    return stencil.median_root_prior(tables.images(spark, sf_dir), ["image_id"], 1, 0.5)


_NUM = "q AS (SELECT segment, view, axial, tang, sum(value) AS num, sum(value * weight) AS den FROM bins GROUP BY ALL)"


@_query(
    f"""WITH {_BINS}, {_NUM}, s AS (SELECT *, max(num) OVER (PARTITION BY segment, view) * 1e-6 AS small FROM q)
SELECT segment, view, axial, tang, CASE WHEN tang NOT BETWEEN -6 AND 6 OR (abs(num) <= small AND abs(den) <= small) THEN 0 WHEN den = 0 THEN 10000 ELSE least(num / den, 10000) END::DOUBLE AS value FROM s"""
)
def divided_and_truncated(spark, sf_dir):
    q = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("num"), F.sum(F.col("value") * F.col("weight")).alias("den"))
    return correct.divide_and_truncate(q, ["segment", "view"], (-6, 6)).select(*BIN, "value")


_WINDOWS = "w AS (SELECT l_partkey % 16 AS view, sum(l_quantity) FILTER (l_returnflag = 'A') AS low, sum(l_quantity) FILTER (l_returnflag = 'N') AS main, sum(l_quantity) FILTER (l_returnflag = 'R') AS high FROM lineitem GROUP BY 1)"


@_query(f"WITH {_WINDOWS} SELECT view, (low / 3 + high / 4) * 10 AS scatter, greatest(main - (low / 3 + high / 4) * 10, 0) AS value FROM w")
def triple_energy_window(spark, sf_dir):
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    w = tables.load(spark, sf_dir, "lineitem").groupBy(F.pmod("l_partkey", F.lit(16)).alias("view")).agg(of("A").alias("low"), of("N").alias("main"), of("R").alias("high"))
    return correct.triple_energy_window(w, ["view"], (3.0, 20.0, 4.0))


@_query(f"WITH {_BINS}, q AS (SELECT segment, view, axial, tang, sum(value) AS v, sum(weight) AS r, avg(weight) AS s FROM bins GROUP BY ALL) SELECT segment, view, axial, tang, (v - r) * (1 + s) * exp(s) - s AS value FROM q")
def precorrected_projdata(spark, sf_dir):
    q = tables.bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("value"), F.sum("weight").alias("randoms"), F.avg("weight").alias("scatter"))
    q = q.withColumn("norm", 1 + F.col("scatter")).withColumn("acf", F.exp("scatter"))
    return correct.precorrect(q).select(*BIN, "value")


@_query(f"WITH {_REC} SELECT d1 // 8 AS b1, d2 // 8 AS b2, count(*)::BIGINT AS value FROM rec WHERE is_prompt GROUP BY ALL")
def block_sums(spark, sf_dir):
    return correct.block_sums(tables.records(spark, sf_dir).filter("is_prompt").select("d1", "d2", F.lit(1).alias("value")), 8)


def _eff_sql(updates: int) -> str:
    steps = ["e0 AS (SELECT i AS det, 1.0::DOUBLE AS eff FROM range(64) q(i))"]
    for k in range(updates):
        steps.append(
            f"n{k} AS (SELECT both_.det, sum(value) AS fan, sum(model * eff) AS expected FROM both_ JOIN e{k} ON e{k}.det = other GROUP BY 1), "
            f"e{k + 1} AS (SELECT det, coalesce(sqrt(eff * fan / nullif(expected, 0)), 0) AS eff FROM e{k} LEFT JOIN n{k} USING (det))"
        )
    return (
        f"WITH {_REC}, h AS (SELECT d1, d2, count(*) AS value, 1.5::DOUBLE AS model FROM rec WHERE is_prompt AND d1 <> d2 GROUP BY d1, d2), two AS (SELECT d1 AS det, d2 AS other, value, model FROM h UNION ALL SELECT d2, d1, value, model FROM h), "
        f"both_ AS (SELECT det, other, sum(value) AS value, sum(model) AS model FROM two GROUP BY ALL), {', '.join(steps)} SELECT det, eff FROM e{updates}"
    )


@_query(_eff_sql(3))
def ml_efficiencies(spark, sf_dir):
    pairs = tables.records(spark, sf_dir).filter("is_prompt").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("value")).withColumn("model", F.lit(1.5))
    return correct.ml_efficiencies(pairs, spark.range(64).withColumnRenamed("id", "det"), 3)


@_query(f"WITH {_IMG}, par AS (SELECT image_id, y, x, min(value) AS ki, max(value) AS vb FROM img GROUP BY ALL) SELECT image_id, y, x, f AS frame, ki * (2.0 * f + 1) + vb * exp(-0.1 * f) AS value FROM par, range(8) q(f)")
def dynamic_from_parameters(spark, sf_dir):
    par = tables.images(spark, sf_dir).groupBy("image_id", "y", "x").agg(F.min("value").alias("ki"), F.max("value").alias("vb"))
    model = spark.range(8).select(F.col("id").alias("frame"), (2.0 * F.col("id") + 1).alias("integral"), F.exp(-0.1 * F.col("id")).alias("plasma"))
    return correct.dynamic_from_parameters(par, model, ["image_id", "y", "x"])


@_query(f"WITH {_REC}, {_FOLD} SELECT frame, ring, view, tang, sum(CASE WHEN is_prompt THEN 1 ELSE -1 END)::BIGINT AS value FROM det WHERE frame IS NOT NULL GROUP BY ALL")
def streamed_binning(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return streamed.binned(tables.as_records(streamed.event_stream(spark, path), spark.read.parquet(path).agg(F.min("ts")).first()[0]), 64, FRAMES)
