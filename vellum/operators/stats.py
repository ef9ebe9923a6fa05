"""Robust statistics and plane fits, as aggregates of a few passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def medians(rows: DataFrame, keys: list[str], value: str, name: str, near: float = 0.001) -> DataFrame:
    """(keys, name): the exact median of each group's values, in memory that does not grow with the group. A sketch gives two values
    whose ranks are at most 2 * `near` apart and on both sides of the middle; the values between them are counted, the ones
    below only summed up. Null and NaN values take no part, nor groups with a null key."""
    df = rows.select(*keys, F.col(value).cast("double").alias("__v")).where("not isnan(__v)").dropna(subset=[*keys, "__v"])
    ends = F.percentile_approx("__v", [0.5 - near, 0.5 + near], int(10 / near))
    sketch = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), ends.alias("__e"))
    here = df.join(sketch, keys).where(F.col("__v") <= F.col("__e")[1])
    counted = here.groupBy(*keys, "__n", F.when(F.col("__v") >= F.col("__e")[0], F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = counted.withColumn("__c", F.sum("__c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("__v"))))
    at = lambda k: F.min(F.when(F.col("__c") >= k, F.col("__v")))
    return ranked.groupBy(*keys).agg((at(F.floor((F.col("__n") + 1) / 2)) * 0.5 + at(F.floor(F.col("__n") / 2) + 1) * 0.5).alias(name))


def robust_centroid(vectors: DataFrame, group: str, vector: str, limit: float) -> DataFrame:
    """(group, n_inliers, centroid): component-wise median of the vectors nearer than limit to the median of all."""

    def middle(df: DataFrame, name: str) -> DataFrame:
        each = medians(df.select(group, F.posexplode(vector).alias("i", "x")), [group, "i"], "x", "m")
        return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias(name))

    near = F.sqrt(F.aggregate(F.zip_with(vector, "c", lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, d: s + d)) < limit
    inliers = vectors.join(middle(vectors, "c"), group).where(near).drop("c")
    return inliers.groupBy(group).agg(F.count(F.lit(1)).alias("n_inliers")).join(middle(inliers, "centroid"), group)


def mad_trimmed(rows: DataFrame, group: Column, value: str, floor: float = 34.0, times: float = 3.0) -> DataFrame:
    """Rows within max(floor, times * (MAD + 1)) of their group's median."""
    df = rows.withColumn("g", group)
    df = df.join(medians(df, ["g"], value, "med"), "g").withColumn("__off", F.abs(F.col(value) - F.col("med")))
    mad = medians(df, ["g"], "__off", "mad").withColumn("mad", F.col("mad") + 1)
    return df.join(mad, "g").where(F.col("__off") < F.greatest(F.lit(floor), F.col("mad") * times)).drop("__off")


def plane_fit(points: DataFrame, group: str, x: Column, y: Column, z: Column) -> DataFrame:
    """(group, a, b, c): least squares z = a*x + b*y + c from sums, solved in closed form; null where singular."""
    p = points.select(group, x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    n = p.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.expr(e)).alias(f"m{i}") for i, e in enumerate(("x", "y", "z", "x*x", "y*y", "x*y", "x*z", "y*z"))])
    cov = lambda m, a, b: F.col(m) - F.col(a) * F.col(b)
    n = n.withColumns({"xx": cov("m3", "m0", "m0"), "yy": cov("m4", "m1", "m1"), "xy": cov("m5", "m0", "m1"), "xz": cov("m6", "m0", "m2"), "yz": cov("m7", "m1", "m2")})
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.when(F.abs(det) > 1e-9, det)
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.when(F.abs(det) > 1e-9, det)
    return n.withColumns({"a": a, "b": b}).select(group, "a", "b", (F.col("m2") - F.col("a") * F.col("m0") - F.col("b") * F.col("m1")).alias("c"))
