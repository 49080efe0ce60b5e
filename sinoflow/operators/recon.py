"""Projection through sparse system matrices, and iterative reconstruction.

The matrix is a table (bin, voxel, a), projections (bin, value), images (voxel, value), with any keys before them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoflow.functions.scalar import clamp, log_likelihood_term, safe_divide
from sinoflow.operators import stencil
from sinoflow.sources.tables import saved


def parallel_matrix(spark, n: int) -> DataFrame:
    """Four views of parallel lines over an n x n grid: view, t, y, x, a (length within the pixel)."""
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("y"), F.pmod("id", F.lit(n)).cast("int").alias("x"))
    views = [(0, F.col("x"), 1.0), (1, F.col("x") + F.col("y"), math.sqrt(2)), (2, F.col("y"), 1.0), (3, F.col("x") - F.col("y") + n - 1, math.sqrt(2))]
    lines = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), t.cast("int").alias("t"), F.lit(a).alias("a")) for v, t, a in views)))
    return grid.select("y", "x", lines.alias("l")).select("l.view", "l.t", "y", "x", "l.a")


def forward(matrix: DataFrame, image: DataFrame, by: list[str], bins=("view", "t"), voxels=("y", "x")) -> DataFrame:
    """y_b = sum over v of A_bv x_v."""
    return image.join(matrix, list(voxels)).groupBy(*by, *bins).agg(F.sum(F.col("a") * F.col("value")).alias("value"))


def backward(matrix: DataFrame, data: DataFrame, by: list[str], bins=("view", "t"), voxels=("y", "x"), squared: bool = False) -> DataFrame:
    """x_v = sum over b of A_bv y_b, or of its square."""
    a = F.col("a") * F.col("a") if squared else F.col("a")
    return data.join(matrix, list(bins)).groupBy(*by, *voxels).agg(F.sum(a * F.col("value")).alias("value"))


def osem(matrix: DataFrame, data: DataFrame, start: DataFrame, by: list[str], n_subsets: int, n_updates: int, background: float = 0.0, small: float = 1e-10) -> DataFrame:
    """Ordered-subsets expectation maximisation: x <- x * back(y / (forward x + background)) / sensitivity, a view subset at a time."""
    keys = [*by, "y", "x"]
    image = start
    for update in range(n_updates):
        part = matrix.filter(F.pmod("view", F.lit(n_subsets)) == update % n_subsets)
        mean = forward(part, image, by).withColumnRenamed("value", "mean")
        ratio = data.join(mean, [*by, "view", "t"]).select(*by, "view", "t", safe_divide(F.col("value"), F.col("mean") + background, small).alias("value"))
        back = backward(part, ratio, by).withColumnRenamed("value", "m")
        sens = part.groupBy("y", "x").agg(F.sum("a").alias("sens"))
        new = image.join(back, keys).join(sens, ["y", "x"])
        image = saved(new.select(*keys, safe_divide(F.col("value") * F.col("m"), F.col("sens"), small).alias("value")))
    return image


def _with_estimate(matrix: DataFrame, data: DataFrame, image: DataFrame, by: list[str], background: float) -> DataFrame:
    """by, view, t, value, mean over bins that have counts or an estimate; what one side lacks is 0."""
    mean = forward(matrix, image, by).withColumnRenamed("value", "mean")
    rows = data.join(mean, [*by, "view", "t"], "full")
    return rows.select(*by, "view", "t", F.coalesce("value", F.lit(0.0)).alias("value"), (F.coalesce("mean", F.lit(0.0)) + background).alias("mean"))


def log_likelihood(matrix: DataFrame, data: DataFrame, image: DataFrame, by: list[str], background: float = 0.0) -> DataFrame:
    """Poisson log-likelihood; counts up to a millionth of the largest of their viewgram are taken for none."""
    rows = _with_estimate(matrix, data, image, by, background)
    small = rows.groupBy(*by, "view").agg((F.max("value") * 1e-6).alias("small"))
    terms = rows.join(small, [*by, "view"]).select(*by, log_likelihood_term(F.col("value"), F.col("mean"), F.col("small")).alias("l"))
    return terms.groupBy(*by).agg(F.sum("l").alias("log_likelihood"))


def hessian_row_sums(matrix: DataFrame, data: DataFrame, image: DataFrame, by: list[str], background: float = 0.0, small: float = 1e-10) -> DataFrame:
    """Sums of the rows of minus the log-likelihood's Hessian: back projection of (projection of ones) * counts / mean squared."""
    ones = matrix.groupBy("view", "t").agg(F.sum("a").alias("ones"))
    rows = _with_estimate(matrix, data, image, by, background).join(ones, ["view", "t"])
    curved = rows.select(*by, "view", "t", safe_divide(F.col("ones") * F.col("value"), F.col("mean") * F.col("mean"), small).alias("value"))
    return backward(matrix, curved, by)


def sensitivity(matrix: DataFrame, efficiencies: DataFrame | None = None, bins=("view", "t"), voxels=("y", "x")) -> DataFrame:
    """Back projection of ones, or of bin efficiencies (bins, eff): the columns ``voxels`` and ``sens``."""
    a = F.col("a") if efficiencies is None else F.col("a") * F.col("eff")
    rows = matrix if efficiencies is None else matrix.join(efficiencies, list(bins))
    return rows.groupBy(*voxels).agg(F.sum(a).alias("sens"))


def zero_unseen(image: DataFrame, sens: DataFrame, voxels=("y", "x")) -> DataFrame:
    """Set voxels without sensitivity to zero."""
    seen = sens.filter("sens > 0").select(*voxels, F.lit(True).alias("seen"))
    return image.join(seen, list(voxels), "left").withColumn("value", F.when(F.col("seen"), F.col("value")).otherwise(0.0)).drop("seen")


def subset_balance(matrix: DataFrame, n_subsets: int) -> DataFrame:
    """Viewgrams a subset; a difference means unbalanced subsets."""
    return matrix.select("view").distinct().groupBy(F.pmod("view", F.lit(n_subsets)).alias("subset")).agg(F.count(F.lit(1)).alias("viewgrams"))


def map_osl(matrix: DataFrame, data: DataFrame, start: DataFrame, image_key: str, n_subsets: int, n_updates: int, beta: float, background: float = 0.0, small: float = 1e-10, multiplicative: bool = False) -> DataFrame:
    """One-step-late maximum a posteriori updates with a quadratic prior over the image (z, y, x).

    The additive form divides by the sensitivity plus the prior's gradient over the subsets, kept within a tenth and ten
    times the sensitivity; the multiplicative form by the sensitivity times one plus the gradient, kept within 0.1 and 10.
    """
    by = [image_key, "z"]
    keys, image = [*by, "y", "x"], start
    for update in range(n_updates):
        part = matrix.filter(F.pmod("view", F.lit(n_subsets)) == update % n_subsets)
        mean = forward(part, image, by).withColumnRenamed("value", "mean")
        ratio = data.join(stencil.never_broadcast(mean), [*by, "view", "t"]).select(*by, "view", "t", safe_divide(F.col("value"), F.col("mean") + background, small).alias("value"))
        back = backward(part, ratio, by).withColumnRenamed("value", "m")
        slope = stencil.prior(image, [image_key], "quadratic").select(*keys, (F.col("gradient") * beta).alias("slope"))
        rows = image.join(stencil.never_broadcast(back), keys).join(stencil.never_broadcast(slope), keys).join(sensitivity(part), ["y", "x"])
        sens = F.col("sens")
        if multiplicative:
            den = clamp(1 + F.col("slope"), 0.1, 10.0) * sens
        else:
            den = F.least(F.greatest(F.col("slope") / n_subsets + sens, sens / 10), sens * 10)
        image = saved(rows.select(*keys, safe_divide(F.col("value") * F.col("m"), den, small).alias("value")))
    return image


def ossps(matrix: DataFrame, data: DataFrame, start: DataFrame, by: list[str], n_subsets: int, n_updates: int, relaxation: float = 1.0, gamma: float = 0.1, background: float = 0.0, upper: float = 1e6, small: float = 1e-10) -> DataFrame:
    """Separable paraboloidal surrogates: x <- clamp(x + zeta * subsets * gradient / D, 0, upper).

    D is the back projection of (the projection of ones) / measured, zeta = relaxation / (1 + gamma * full iterations, the update under way counted).
    """
    keys, image = [*by, "y", "x"], start
    ones = matrix.groupBy("view", "t").agg(F.sum("a").alias("ones"))
    curved = data.join(ones, ["view", "t"]).select(*by, "view", "t", safe_divide(F.col("ones"), F.col("value"), small).alias("value"))
    bound = saved(backward(matrix, curved, by).withColumnRenamed("value", "bound"))
    for update in range(n_updates):
        zeta = relaxation / (1 + gamma * ((update + 1) // n_subsets))
        part = matrix.filter(F.pmod("view", F.lit(n_subsets)) == update % n_subsets)
        own = data.filter(F.pmod("view", F.lit(n_subsets)) == update % n_subsets)
        rest = _with_estimate(part, own, image, by, background).select(*by, "view", "t", (safe_divide(F.col("value"), F.col("mean"), small) - 1).alias("value"))
        step = backward(part, rest, by).withColumnRenamed("value", "step")
        rows = image.join(step, keys).join(bound, keys)
        moved = F.col("value") + zeta * n_subsets * safe_divide(F.col("step"), F.col("bound"), small)
        image = saved(rows.select(*keys, clamp(moved, 0.0, upper).alias("value")))
    return image


def ramp_kernel(n: int) -> list[float]:
    """Samples 0 to n - 1 of the band-limited ramp filter at unit spacing."""
    return [0.25 if k == 0 else -1 / (math.pi * k) ** 2 if k % 2 else 0.0 for k in range(n)]


def ramp_filter(data: DataFrame, line: list[str], n: int) -> DataFrame:
    """Convolve every line of bins t = 0 ... n - 1 with the ramp; one shuffle on the line, then array expressions."""
    kernel = F.array(*(F.lit(v) for v in ramp_kernel(n)))
    rows = data.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("v"))  # at most n bins a line
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.coalesce(F.col("v")[t], F.lit(0.0)))
    rows = rows.select(*line, full.alias("v"))

    def at(t):
        terms = F.transform(F.col("v"), lambda x, s: x * F.element_at(kernel, F.abs(t - s) + 1))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    return rows.select(*line, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).alias("t", "value"))


def fbp(matrix: DataFrame, data: DataFrame, by: list[str], n: int, n_views: int) -> DataFrame:
    """Filtered back projection of parallel lines: ramp, back projection, scaling by pi over the views."""
    image = backward(matrix, ramp_filter(data, [*by, "view"], n), by)
    return image.withColumn("value", F.col("value") * (math.pi / n_views))
