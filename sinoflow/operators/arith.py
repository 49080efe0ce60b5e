"""Arithmetic of whole data sets, aligned by their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoflow.functions.scalar import pow_times_add

FUNCTIONS = {"log": F.log, "exp": F.exp, "abs": F.abs, "sqrt": F.sqrt, "negative": lambda x: -x}


def apply(rows: DataFrame, name: str, value: str = "value") -> DataFrame:
    """One of FUNCTIONS applied to every element."""
    return rows.withColumn(value, FUNCTIONS[name](F.col(value)))


def combine(tables: list[DataFrame], keys: list[str], how: str = "add", including_first: bool = False, **chain) -> DataFrame:
    """Sum or product of N data sets; ``chain`` (power, times, add, low, high) is put on all but the first, or on all.

    One aggregation over their union, with no chain of joins. An element that one of them lacks raises.
    """
    change = lambda t: t.select(*keys, pow_times_add(F.col("value").cast("double"), **chain).alias("value"))
    parts = [change(t) if chain and (including_first or i) else t.select(*keys, F.col("value").cast("double").alias("value")) for i, t in enumerate(tables)]
    whole = reduce(DataFrame.unionByName, parts)
    merged = {"add": F.sum, "multiply": F.product}[how]("value")
    enough = F.when(F.count(F.lit(1)) == len(tables), merged).otherwise(F.raise_error(F.lit("data sets differ in their elements")).cast("double"))
    return whole.groupBy(*keys).agg(enough.alias("value"))


def axpby(x: DataFrame, a: Column | float | DataFrame, y: DataFrame, b: Column | float | DataFrame, keys: list[str]) -> DataFrame:
    """a x + b y; the factors are numbers, expressions over the keys, or data sets themselves."""
    rows = x.select(*keys, F.col("value").alias("_x")).join(y.select(*keys, F.col("value").alias("_y")), keys)
    factors = []
    for name, f in (("_a", a), ("_b", b)):
        if isinstance(f, DataFrame):
            rows = rows.join(f.select(*keys, F.col("value").alias(name)), keys)
            f = F.col(name)
        factors.append(f if isinstance(f, Column) else F.lit(float(f)))
    return rows.select(*keys, (factors[0] * F.col("_x") + factors[1] * F.col("_y")).alias("value"))


def binary(x: DataFrame, y: DataFrame, keys: list[str], sign: str) -> DataFrame:
    """x + y, x - y, x * y or x / y (null for a zero divisor)."""
    rows = x.select(*keys, F.col("value").alias("_x")).join(y.select(*keys, F.col("value").alias("_y")), keys)
    p, q = F.col("_x"), F.col("_y")
    return rows.select(*keys, {"+": p + q, "-": p - q, "*": p * q, "/": F.try_divide(p, q)}[sign].alias("value"))


def inner_products(x: DataFrame, y: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner product, both norms and the angle between two data sets, per ``by``."""
    rows = x.select(*keys, F.col("value").alias("_x")).join(y.select(*keys, F.col("value").alias("_y")), keys)
    p, q = F.col("_x"), F.col("_y")
    out = rows.groupBy(*by).agg(F.sum(p * q).alias("inner"), F.sqrt(F.sum(p * p)).alias("norm_x"), F.sqrt(F.sum(q * q)).alias("norm_y"))
    cosine = F.try_divide("inner", F.col("norm_x") * F.col("norm_y"))
    return out.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def chained_factors(factors: list[DataFrame], keys: list[str]) -> DataFrame:
    """Product of normalisation factors of each bin; one data set of factors is itself, none is not a chain."""
    return combine(factors, keys, "multiply")


def normalise(bins: DataFrame, factors: DataFrame, keys: list[str], undo: bool = False) -> DataFrame:
    """Bins times their factors, or divided by them."""
    return binary(bins, factors, keys, "/" if undo else "*")


def standard_order(rows: DataFrame, *then: str) -> DataFrame:
    """Segments in the order 0, 1, -1, 2, -2, ..."""
    return rows.orderBy(F.abs("segment"), F.desc("segment"), *then)
