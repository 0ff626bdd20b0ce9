"""Density of occurrences over time for each taxon: histogram, kernel density, quantiles, and trimmed ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import assert_ranges, require, require_number


def points(df: DataFrame, rank: str, srt: str, end: str, density: float) -> DataFrame:
    """(taxon, p, w): the ages at which ranges are sampled, every density from the start (plus density) down to the end, and how many samples fall on each.

    Equal ranges of a taxon are sampled once, with their number as weight, so that what is exploded
    grows with the distinct ranges, not with the occurrences.
    """
    d = F.lit(float(density))
    ranges = df.where(F.col(rank).isNotNull() & F.col(srt).isNotNull() & F.col(end).isNotNull()).groupBy(F.col(rank).cast("string").alias("taxon"), (F.col(srt).cast("double") + d).alias("s"), F.col(end).cast("double").alias("e")).agg(F.count("*").alias("w"))
    steps = F.sequence(F.lit(0), F.floor((F.col("s") - F.col("e")) / d + 1e-10).cast("int"))
    sampled = ranges.select("taxon", "w", "s", "e", F.explode(steps).alias("k"))
    return sampled.groupBy("taxon", F.greatest(F.col("s") - F.col("k") * d, F.col("e")).alias("p")).agg(F.sum("w").alias("w"))


#: Kernels of standard deviation 1: the reach, and the height at a distance u within it.
KERNELS = {
    "gaussian": (None, lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)),
    "rectangular": (math.sqrt(3), lambda u: F.lit(0.5 / math.sqrt(3))),
    "triangular": (math.sqrt(6), lambda u: (1 - F.abs(u) / math.sqrt(6)) / math.sqrt(6)),
    "epanechnikov": (math.sqrt(5), lambda u: 0.75 * (1 - u * u / 5) / math.sqrt(5)),
    "biweight": (math.sqrt(7), lambda u: 15 / 16 * F.pow(1 - u * u / 7, F.lit(2)) / math.sqrt(7)),
    "cosine": (1 / math.sqrt(1 / 3 - 2 / math.pi**2), lambda u: (1 + F.cos(u * (math.pi * math.sqrt(1 / 3 - 2 / math.pi**2)))) * (math.sqrt(1 / 3 - 2 / math.pi**2) / 2)),
    "optcosine": (1 / math.sqrt(1 - 8 / math.pi**2), lambda u: F.cos(u * (math.pi / 2 * math.sqrt(1 - 8 / math.pi**2))) * (math.pi / 4 * math.sqrt(1 - 8 / math.pi**2))),
}
#: Rules of thumb for the bandwidth: the factor of the lesser of deviation and scaled quartile range.
RULES = {"nrd0": 0.9, "nrd": 1.06}


def _binned(pts: DataFrame, step: float, bw: str | float = "nrd0", adjust: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(taxon, a, z, n, all, bw) for each taxon: lower and upper edge, bins, samples, bandwidth; and (taxon, bin, c)."""
    mean = F.sum(F.col("p") * F.col("w")) / F.sum("w")
    var = (F.sum(F.col("p") * F.col("p") * F.col("w")) - F.sum("w") * mean * mean) / (F.sum("w") - 1)
    quantile = lambda q: F.percentile("p", F.lit(q), F.col("w"))
    t = pts.groupBy("taxon").agg(
        F.floor(F.min("p")).alias("a"), F.ceil(F.max("p")).alias("z"), F.sum("w").alias("all"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), (quantile(0.75) - quantile(0.25)).alias("iqr"), F.abs(F.max("p")).alias("x1")
    )
    low = F.least("sd", F.col("iqr") / 1.34)
    low = F.when(low > 0, low).when(F.col("sd") > 0, F.col("sd")).when(F.col("x1") > 0, F.col("x1")).otherwise(1.0)
    t = t.select("taxon", "a", "z", F.greatest(F.lit(1), F.ceil((F.col("z") - F.col("a")) / step)).cast("int").alias("n"), "all", (adjust * (RULES[bw] * low * F.pow("all", F.lit(-0.2)) if isinstance(bw, str) else F.lit(float(bw)))).alias("bw"))
    at = pts.join(t.select("taxon", "a"), "taxon").select("taxon", "w", F.greatest(F.lit(1), F.ceil((F.col("p") - F.col("a")) / step - 1e-7)).cast("int").alias("bin"))
    return t, at.groupBy("taxon", "bin").agg(F.sum("w").alias("c"))


def _kernel(pts: DataFrame, t: DataFrame, kernel: str = "gaussian") -> DataFrame:
    """(taxon, bin, y): the exact sum of kernels at n ages from the lower to the upper edge."""
    place = F.when(F.col("n") > 1, F.col("a") + (F.col("bin") - 1) * ((F.col("z") - F.col("a")) / (F.col("n") - 1))).otherwise(F.col("a"))
    grid = t.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("x", place.cast("double"))
    u = (F.col("x") - F.col("p")) / F.col("bw")
    reach, height = KERNELS[kernel]
    each = height(u) if reach is None else F.when(F.abs(u) < reach, height(u)).otherwise(0.0)
    y = F.sum(F.col("w") * each) / (F.first("all") * F.first("bw"))
    out = grid.join(pts, "taxon").groupBy("taxon", "bin").agg(y.alias("y"), F.first("n").alias("n"))
    total = F.sum("y").over(Window.partitionBy("taxon"))
    return out.select("taxon", "bin", F.when(F.col("n") == 1, 1.0).when(total == 0, 1 / (F.col("n") + 1)).otherwise(F.col("y")).alias("y"))


def _check(df: DataFrame, rank: str, srt: str, end: str, step: float, density: float, validate: bool) -> None:
    require(df, rank)
    require_number(df, srt, end)
    if step < 1 or density <= 0:
        raise ValueError("step is 1 or more, density above 0")
    if validate:
        assert_ranges(df, srt, end)


def densify(df: DataFrame, rank: str = "genus", srt: str = "max_ma", end: str = "min_ma", step: int = 1, density: float = 0.1, method: tuple[str, ...] | str = ("histogram", "kernel"), validate: bool = False, bw: str | float = "nrd0", adjust: float = 1.0, kernel: str = "gaussian") -> DataFrame:
    """(taxon, t, hist, kdensity): the density of each taxon in the bins where it occurs; t is a bin's older edge.

    hist is the number of ranges sampled in the bin, kdensity the kernel density of the samples. kernel is one of
    KERNELS, bw the bandwidth (its standard deviation) or one of RULES, adjust a factor of it. Bins without samples are
    left out (see dense()). Rows without a taxon or an age don't count; an empty table gives no rows.
    """
    if kernel not in KERNELS or isinstance(bw, str) and bw not in RULES or not isinstance(bw, str) and bw <= 0 or adjust <= 0:
        raise ValueError(f"kernel is one of {[*KERNELS]}; bw one of {[*RULES]} or above 0; adjust above 0")
    _check(df, rank, srt, end, step, density, validate)
    methods = {method} if isinstance(method, str) else set(method)
    if not methods or not methods <= {"histogram", "kernel"}:
        raise ValueError("method is one or both of histogram and kernel")
    pts = points(df, rank, srt, end, density)
    t, bins = _binned(pts, step, bw, adjust)
    out = bins.join(t.select("taxon", "a"), "taxon").select("taxon", "bin", (F.col("a") + F.col("bin") * step).cast("double").alias("t"), F.ceil(F.col("c") / (step / density)).cast("long").alias("hist"))
    if "kernel" in methods:
        out = out.join(_kernel(pts, t, kernel), ["taxon", "bin"]).withColumnRenamed("y", "kdensity")
    return out.drop("bin", *(["hist"] if "histogram" not in methods else []))


def dense(profile: DataFrame, step: int = 1, common: bool = False) -> DataFrame:
    """A profile with rows of zeros for the bins between a taxon's first and last one or, with common, between those of all taxa."""
    edges = profile.groupBy("taxon").agg(F.min("t").cast("long").alias("lo"), F.max("t").cast("long").alias("hi"))
    if common:
        edges = edges.select("taxon").crossJoin(F.broadcast(profile.agg(F.min("t").cast("long").alias("lo"), F.max("t").cast("long").alias("hi"))))  # one row
    spine = edges.select("taxon", F.explode(F.transform(F.sequence("lo", "hi", F.lit(step).cast("long")), lambda x: x.cast("double"))).alias("t"))
    return spine.join(profile, ["taxon", "t"], "left").fillna(0)


def quantiles(gridded: DataFrame, probs: list[float], key: str = "taxon", x: str = "x", y: str = "y") -> DataFrame:
    """(key, q0, q1, …): quantiles of densities given at equal steps of x: infinite beyond the grid, else interpolated."""
    up = Window.partitionBy(key).orderBy(x)
    whole = Window.partitionBy(key)
    g = gridded.select(key, F.col(x).alias("x"), F.col(y).alias("y"))
    g = g.withColumn("c", F.sum("y").over(up) - (F.col("y") - F.first("y").over(up)) / 2)
    g = g.withColumn("c", F.col("c") / F.last("c").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = g.withColumns({"c2": F.lead("c").over(up), "x2": F.lead("x").over(up), "m": F.min("c").over(whole)})

    def q(p: float) -> Column:
        inside = (F.col("c") <= p) & (F.col("c2") > p)
        mid = F.max(F.when(inside, F.col("x") + (p - F.col("c")) / (F.col("c2") - F.col("c")) * (F.col("x2") - F.col("x"))))
        return F.when(F.min("m") > p, float("-inf")).otherwise(F.coalesce(mid, F.lit(float("inf"))))

    return g.groupBy(key).agg(*[q(p).alias(f"q{k}") for k, p in enumerate(probs)])


def pacmacro_ranges(df: DataFrame, rank: str = "genus", srt: str = "max_ma", end: str = "min_ma", step: int = 1, density: float = 0.1, top: float = 5, bottom: float = 5, tail_flag: float | list[float] = 0.35, method: str = "histogram", validate: bool = False) -> DataFrame:
    """(taxon, FAD, LAD, FAD95, LAD95, tflag…): each taxon's range, without tails that hold less than top and bottom percent of its density.

    The numbers in the names follow from bottom and top. A bound within a step of the full one is the
    full one. tflag is 1 if the tails are at least that share of the range; null if its length is zero.
    kernel takes quantiles of the kernel density; a taxon of one bin is trimmed by the histogram.
    """
    _check(df, rank, srt, end, step, density, validate)
    if method not in ("histogram", "kernel"):
        raise ValueError("method is histogram or kernel")
    whole = df.where(F.col(rank).isNotNull()).groupBy(F.col(rank).cast("string").alias("taxon")).agg(F.max(F.col(srt).cast("double")).alias("FAD"), F.min(F.col(end).cast("double")).alias("LAD"))
    pts = points(df, rank, srt, end, density)
    t, bins = _binned(pts, step)
    old, young = Window.partitionBy("taxon").orderBy(F.desc("bin")), Window.partitionBy("taxon").orderBy("bin")
    total = F.sum("c").over(Window.partitionBy("taxon"))
    kept = bins.withColumns({"o": F.sum("c").over(old) >= total * top / 100, "y": F.sum("c").over(young) >= total * bottom / 100}).where("o AND y")
    label = F.col("a") + F.col("bin") * step
    cut = kept.join(t.select("taxon", "a"), "taxon").groupBy("taxon").agg(F.max(label).cast("double").alias("hi"), F.min(label).cast("double").alias("lo"))
    if method == "kernel":
        grid = _kernel(pts, t).join(bins.select("taxon", "bin", "c"), ["taxon", "bin"], "left")
        grid = grid.join(t.select("taxon", "a", "z", "n"), "taxon").where("n > 1").select("taxon", (F.col("a") + (F.col("bin") - 1) * ((F.col("z") - F.col("a")) / (F.col("n") - 1))).alias("x"), F.when(F.col("c").isNull(), 0.0).otherwise(F.col("y")).alias("y"))
        q = quantiles(grid, [1 - top / 100, bottom / 100]).select("taxon", F.ceil("q0").cast("double").alias("kh"), F.floor("q1").cast("double").alias("kl"), F.col("q0").isin(float("inf"), float("-inf")).alias("ih"), F.col("q1").isin(float("inf"), float("-inf")).alias("il"))
        cut = cut.join(q, "taxon", "left").select("taxon", F.when(F.col("ih"), float("inf")).otherwise(F.coalesce("kh", "hi")).alias("hi"), F.when(F.col("il"), float("-inf")).otherwise(F.coalesce("kl", "lo")).alias("lo"))
    out = whole.join(cut, "taxon")
    hi = F.when((F.col("hi") > F.col("FAD")) | (F.col("FAD") - F.col("hi") <= step), F.col("FAD")).otherwise(F.col("hi"))
    lo = F.when((F.col("lo") < F.col("LAD")) | (F.col("lo") - F.col("LAD") <= step), F.col("LAD")).otherwise(F.col("lo"))
    fad, lad = f"FAD{100 - bottom:g}".replace(".", "_"), f"LAD{100 - top:g}".replace(".", "_")
    out = out.select("taxon", "FAD", "LAD", hi.alias(fad), lo.alias(lad))
    dur = F.abs(F.col("FAD") - F.col("LAD"))
    tails = (F.col("FAD") - F.col(fad)) + (F.col(lad) - F.col("LAD"))
    for z in [tail_flag] if isinstance(tail_flag, (int, float)) else tail_flag:
        out = out.withColumn(f"tflag{z:g}".replace(".", "_"), F.when(dur > 0, (tails / dur >= z).cast("int")))
    return out


def density_profile(profile: DataFrame, taxon: str, step: int = 1) -> DataFrame:
    """What a plot of one taxon's profile shows: its bins from the first to the last where it occurs."""
    return dense(profile.where(F.col("taxon") == taxon), step)
