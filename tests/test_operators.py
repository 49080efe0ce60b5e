"""Operators whose results SQL does not give, and cases that the driver's tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoflow.functions import scalar
from sinoflow.operators import analysis, arith, frames, listmode, penalised, raytrace, rebin, recon, reduce, stencil
from sinoflow.plans import job
from sinoflow.sources import headers, tables


def test_random_rejection_and_noise(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "rec_no")
    kept = listmode.keep_at_random(rows, 0.3)
    assert abs(kept.count() - 6000) < 300
    assert kept.exceptAll(listmode.keep_at_random(rows.repartition(7), 0.3)).count() == 0  # the key decides
    for mean in (0.0, 0.5, 12.0, 400.0):
        drawn = analysis.poisson_noise(rows.withColumn("value", F.lit(mean)), ["rec_no"]).agg(F.avg("value").alias("m"), F.variance("value").alias("v")).first()
        assert drawn.m == pytest.approx(mean, rel=0.03, abs=0.01) and drawn.v == pytest.approx(mean, rel=0.06, abs=0.02)


def test_likelihood_keeps_bins_without_counts(spark):
    """Bins that data or estimate lack count as 0."""
    m = recon.parallel_matrix(spark, 4)
    image = spark.createDataFrame([(0, y, x, float(1 + x)) for y in range(4) for x in range(4)], "k int, y int, x int, value double")
    data = recon.forward(m, image, ["k"]).withColumn("value", F.when(F.col("t") % 2 == 0, 0.0).otherwise(F.col("value")))
    ones = image.withColumn("value", F.lit(1.0))
    whole = recon.log_likelihood(m, data, ones, ["k"], 0.5).first()[1]
    assert recon.log_likelihood(m, data.filter("value > 0"), ones, ["k"], 0.5).first()[1] == pytest.approx(whole)
    empty = recon.log_likelihood(m, data, ones.limit(0), ["k"], 0.5).first()
    assert empty is not None
    a = sorted(map(tuple, recon.ossps(m, data, ones, ["k"], 1, 2).select("k", "y", "x", F.round("value", 9)).collect()))
    b = sorted(map(tuple, recon.ossps(m, data.filter("value > 0"), ones, ["k"], 1, 2).select("k", "y", "x", F.round("value", 9)).collect()))
    assert a == b


def test_rays(spark):
    """Chords of a ray add up to its length in the square; several rays keep the mean."""
    for rays in (1, 3):
        sums = {(r.view, r.t): r.n for r in raytrace.ray_matrix(spark, 8, 9, 8, 1.0, rays).groupBy("view", "t").agg(F.sum("a").alias("n")).collect()}
        for t in range(9):
            off = np.abs(t - 4 + (np.arange(rays) + 0.5) / rays - 0.5)  # a ray along the square's border is half inside
            inside = np.mean(np.where(np.abs(off - 4) < 1e-9, 0.5, off < 4))
            assert sums.get((0, t), 0.0) == pytest.approx(8 * float(inside))
        assert sums[2, 4] == pytest.approx(8 * np.sqrt(2), rel=0.2 if rays > 1 else 1e-9)


def test_data_sets_that_differ(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, value double")
    with pytest.raises(Exception, match="differ"):
        arith.combine([a, a.filter("k = 1")], ["k"]).collect()
    assert {r.k: r.value for r in arith.normalise(arith.normalise(a, a, ["k"]), a, ["k"], undo=True).collect()} == {1: 2.0, 2: 3.0}


def test_slices_meet_by_coordinate():
    place = {(s, a): (o, b, n) for s, a, o, b, n in rebin.axial_map({-1: 3, 0: 4, 1: 3}, 3)}
    assert place[0, 0] == (0, 0, 1) and place[-1, 0] == place[1, 0] == (0, 1, 2) and place[0, 3] == (0, 6, 1)


def test_line_fit_chi_square(spark):
    rng = np.random.default_rng(1)
    x, y, w = rng.random(30), rng.random(30), 1 + rng.random(30)
    rows = spark.createDataFrame([(0, float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "k int, x double, y double, w double")
    got = reduce.weighted_line(rows, ["k"], F.col("x"), F.col("y"), F.col("w")).first().asDict()
    slope, offset = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert got["chi_square"] == pytest.approx(float((w * (y - slope * x - offset) ** 2).sum()), rel=1e-6)


def test_gates(spark, tmp_path):
    path = tmp_path / "a.gdef"
    path.write_text("3 50.5\n1 10\n0 2\n")
    assert [(r.gate, r.duration_s) for r in headers.read_gates(spark, str(path)).orderBy("seq").collect()] == [(3, 50.5), (1, 10.0), (0, 2.0)]
    path.write_text("1 -4\n")
    with pytest.raises(Exception, match="not a gate"):
        headers.read_gates(spark, str(path)).collect()


def test_bootstrap(spark):
    """As many draws as events, whatever the partitions; the numbers of draws are spread like Poisson's of mean 1."""
    events = spark.range(6000).select(F.col("id").alias("rec_no"), (F.col("id") % 2).alias("ring"))
    found = frames.bootstrap(events, ["ring"])
    assert found.exceptAll(frames.bootstrap(events.repartition(5), ["ring"])).count() == 0
    for r in found.groupBy("ring").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("k"), F.avg((F.col("times") == 0).cast("double")).alias("none")).collect():
        assert r.n == r.k == 3000 and abs(r.none - 0.3679) < 0.03
    assert frames.bootstrap(events.limit(0), ["ring"]).count() == 0


@pytest.mark.parametrize("kind", ["quadratic", "logcosh", "relative_difference"])
def test_hessian_is_the_change_of_the_gradient(spark, kind):
    rows = [(0, z, y, x, 1.0 + ((3 * z + 5 * y + 7 * x) % 11) / 4, ((z + 2 * y + x) % 5) / 3.0) for z in range(3) for y in range(3) for x in range(3)]
    image = spark.createDataFrame(rows, "k int, z int, y int, x int, value double, input double")
    step = 1e-5
    moved = [penalised.weighted_prior(image.withColumn("value", F.col("value") + s * F.col("input")), ["k"], kind) for s in (step, -step)]
    of = lambda df, c: {(r.z, r.y, r.x): r[c] for r in df.collect()}
    up, down = of(moved[0], "gradient"), of(moved[1], "gradient")
    for at, v in of(penalised.hessian_times(image, ["k"], kind), "output").items():
        assert v == pytest.approx((up[at] - down[at]) / (2 * step), abs=1e-6)


def test_metz_kernel():
    """Power 0 is the Gaussian; any power keeps the sum and sharpens."""
    import math

    sigma = 3.0 / math.sqrt(8 * math.log(2))
    plain = penalised.metz_kernel(3.0, 0.0, 8)
    assert plain == pytest.approx([math.exp(-(k * k) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi)) for k in range(-8, 9)], abs=1e-3)
    sharp = penalised.metz_kernel(3.0, 2.0, 20)
    assert sum(sharp) == pytest.approx(1, abs=1e-3) and sharp[20] > plain[8]
    assert penalised.metz_kernel(200.0, 1.0, 1)[1] < 0.1  # so wide that its transfer function underflows


def test_job_of_ossps_takes_its_prior(spark):
    m = recon.parallel_matrix(spark, 4)
    image = spark.createDataFrame([(0, 0, y, x, float(1 + x * y)) for y in range(4) for x in range(4)], "image_id int, z int, y int, x int, value double")
    data, ones = recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0))
    text = "OSSPSParameters :=\nprior type := quadratic\npenalisation factor := {}\nnumber of subsets := 2\nnumber of subiterations := 3\nEND :="
    spread = lambda beta: job.run(text.format(beta), m, data, ones).agg(F.stddev_pop("value")).first()[0]
    none, much = spread(0), spread(50)
    assert none == pytest.approx(recon.ossps(m, data, ones, ["image_id", "z"], 2, 3).agg(F.stddev_pop("value")).first()[0])
    assert much < 0.5 * none


def test_stamps_and_frames(spark):
    stamps = spark.createDataFrame([("19700102000001.5-0100",), ("20000101000000",), ("no",), (None,)], "s string")
    assert [r[0] for r in stamps.select(scalar.seconds_of_stamp(F.col("s"))).collect()] == [86400 + 3601.5, 946684800.0, None, None]
    with pytest.raises(Exception, match="frame without times"):
        frames.calibrated(spark.createDataFrame([(2, 1.0)], "frame int, value double"), [(0.0, 1.0)], 10.0).collect()


def test_singles_are_added_in_order_of_time(spark):
    """Each share is count times overlap over length; the last digit does not depend on partitions."""
    slices = [(u, 7200.0 * k, 7200.0 * (k + 1), (13 * k + 5 * u) % 23 + 1) for u in range(4) for k in range(50)]
    want = {}
    for u, a, b, n in slices:
        for k in range(int(a // 10_000), int(-(-b // 10_000))):
            c = k * 10_000.0
            want[u, c] = want.get((u, c), 0.0) + n * (min(b, c + 10_000) - max(a, c)) / (b - a)
    for rows in (slices, slices[::-1], slices[::2] + slices[1::2]):
        df = spark.createDataFrame(rows, "unit int, start_s double, end_s double, n long").repartition(7)
        assert {(r.unit, r.slice_s): r.n for r in listmode.singles_rebin(df, 10_000.0).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vectors(spark, tmp_path):
    """Two images of 8 x 8 x 8, as Spark reads and explodes them: few bytes, many rows."""
    spark.range(16).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 7 + F.col("id")) % 11).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    return tables.images(spark, str(tmp_path))


@pytest.mark.parametrize("kind", ["logcosh", "quadratic", "relative_difference"])
def test_priors_broadcast_no_voxels(spark, tmp_path, kind):
    """A voxel and its 26 neighbours are taken for as few bytes as the file has."""
    assert "Broadcast" not in _plan(stencil.prior(_vectors(spark, tmp_path), ["image_id"], kind))


def test_curvatures_broadcast_no_voxels(spark, tmp_path):
    assert "Broadcast" not in _plan(penalised.surrogate_curvature(_vectors(spark, tmp_path), ["image_id"], "logcosh"))


@pytest.mark.parametrize("multiplicative", [False, True])
def test_map_updates_broadcast_no_voxels(spark, tmp_path, monkeypatch, multiplicative):
    """Only the matrix and its sums are broadcast, by bins or pixels; joins by image merge."""
    plans = []
    monkeypatch.setattr(recon, "saved", lambda df: plans.append(_plan(df)) or df)
    m, image = recon.parallel_matrix(spark, 8), _vectors(spark, tmp_path)
    recon.map_osl(m, recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0)), "image_id", 2, 1, 0.2, multiplicative=multiplicative)
    joins = [line for line in plans[0].splitlines() if "Join" in line]
    assert joins and not any("Broadcast" in line and "image_id" in line for line in joins)


def test_job_with_a_prior_broadcasts_no_voxels(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(recon, "saved", lambda df: plans.append(_plan(df)) or df)
    m, image = recon.parallel_matrix(spark, 8), _vectors(spark, tmp_path)
    text = "OSMAPOSLParameters :=\nprior type := quadratic\npenalisation factor := 0.2\nnumber of subsets := 2\nnumber of subiterations := 1\nEND :="
    job.run(text, m, recon.forward(m, image, ["image_id", "z"]), image.withColumn("value", F.lit(1.0)))
    assert plans and not any("Broadcast" in line and "image_id" in line for line in plans[0].splitlines() if "Join" in line)
