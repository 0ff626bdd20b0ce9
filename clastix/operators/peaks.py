"""Peaks and troughs of density profiles, and taxa split where their peaks lie far apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ThresholdResult, require, require_number
from ..shared import fresh
from .density import dense, densify

SPAN = 0.2


def smoother(n: int, span: float = SPAN) -> np.ndarray:
    """The matrix of a running straight line of fixed span over n equal steps: at each place the fit to its neighbours, near the ends to the outermost ones."""
    half = max(2, int(0.5 * span * n + 0.5))
    if 2 * half + 1 > n:
        half = (n - 1) // 2
    if half < 1:
        return np.eye(n)
    x = np.arange(-half, half + 1)
    out = np.zeros((n, n))
    for j in range(n):
        a = min(max(j - half, 0), n - 2 * half - 1)
        out[j, a : a + 2 * half + 1] = 1 / len(x) + x / (x * x).sum() * (j - a - half)
    return out


def find_peaks(profile: DataFrame, value: str = "kdensity", win: int = 5, step: int = 1) -> DataFrame:
    """(taxon, seq, kind, t, value, sig_mean, sig_mean_sd): peaks and the troughs between them, from old to young.

    profile: taxon, t and value, as densify() gives it; missing bins are zero. A plateau counts as its
    oldest bin. A peak is significant if the smoothed values about it exceed the mean (and one standard
    deviation) of those within win bins on either side; the only peak, or the highest if none is, is.
    """
    require(profile, "taxon", "t", value)
    if win < 2:
        raise ValueError("win is 2 or more")
    rows = dense(profile.select("taxon", "t", F.col(value).cast("double").alias("v")), step)
    down = Window.partitionBy("taxon").orderBy(F.desc("t"))
    near = F.array(*[F.coalesce(F.lag("v", -k).over(down) if k < 0 else F.lead("v", k).over(down) if k else F.col("v"), F.lit(0.0)) for k in range(-win, win + 1)])
    edges = rows.withColumns({"before": F.lag("v").over(down), "w": near}).where("before IS NULL OR before <> v")
    edges = edges.withColumns({"b": F.coalesce(F.lag("v").over(down), F.lit(0.0)), "a": F.coalesce(F.lead("v").over(down), F.lit(0.0))})
    edges = edges.withColumn("top", F.when((F.col("v") > F.col("b")) & (F.col("v") > F.col("a")), True).when((F.col("v") < F.col("b")) & (F.col("v") < F.col("a")), False)).where("top IS NOT NULL")
    edges = edges.withColumn("k", F.row_number().over(Window.partitionBy("taxon", "top").orderBy(F.desc("t"))))
    lines = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in smoother(2 * win + 1)])
    plus = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    n, s = 2 * win + 1, F.col("s")
    tops = edges.where("top").withColumn("s", F.transform(lines, lambda line: plus(F.zip_with(line, "w", lambda x, y: x * y)))).withColumn("mean", plus(s) / n)
    tops = tops.withColumns({"high": F.array_max(F.slice("s", win, 3)), "sd": F.sqrt(plus(F.transform(s, lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / (n - 1))})
    every = Window.partitionBy("taxon")
    tops = tops.withColumns({"m": F.col("high") > F.col("mean"), "d": F.col("high") > F.col("mean") + F.col("sd"), "n": F.count("*").over(every), "best": F.row_number().over(every.orderBy(F.desc("v"), F.desc("t")))})
    mark = lambda c: (F.col("n") == 1) | F.col(c) | ((F.col("best") == 1) & ~F.bool_or(c).over(every))
    tops = tops.select("taxon", "k", "t", "v", "n", mark("m").alias("sig_mean"), mark("d").alias("sig_mean_sd"))
    low = edges.where("NOT top").select(F.col("taxon").alias("x"), F.col("k").alias("i"), F.col("t").alias("lt"), F.col("v").alias("lv"))
    both = tops.join(low, (F.col("taxon") == F.col("x")) & (F.col("k") == F.col("i")) & (F.col("k") < F.col("n")), "left")
    pair = F.array(F.struct((2 * F.col("k") - 1).cast("int").alias("seq"), F.lit("peak").alias("kind"), F.col("t").alias("t"), F.col("v").alias("value")), F.when(F.col("lt").isNotNull(), F.struct((2 * F.col("k")).cast("int").alias("seq"), F.lit("trough").alias("kind"), F.col("lt").alias("t"), F.col("lv").alias("value"))))
    return both.select("taxon", F.explode(F.filter(pair, lambda p: p.isNotNull())).alias("p"), "sig_mean", "sig_mean_sd").select("taxon", "p.*", "sig_mean", "sig_mean_sd")


def peak_counts(peaks: DataFrame) -> DataFrame:
    """(taxon, all, mean_sd, mean): how many peaks each taxon has, and how many significant ones."""
    p = peaks.where("kind = 'peak'")
    return p.groupBy("taxon").agg(F.count("*").alias("all"), F.count_if("sig_mean_sd").alias("mean_sd"), F.count_if("sig_mean").alias("mean"))


def peak_overlay(peaks: DataFrame, taxon: str) -> DataFrame:
    """(series, t, value): the peaks of one taxon as the series all, mean and mean_sd of a plot."""
    p = peaks.where((F.col("taxon") == taxon) & (F.col("kind") == "peak"))
    every = p.select(F.lit("all").alias("series"), "t", "value")
    return every.unionByName(p.where("sig_mean").select(F.lit("mean").alias("series"), "t", "value")).unionByName(p.where("sig_mean_sd").select(F.lit("mean_sd").alias("series"), "t", "value"))


def breaks(peaks: DataFrame, thresh: float | DataFrame, use_sd: bool = True) -> DataFrame:
    """(taxon, pre, cuts): the significant peaks of each taxon, and the troughs between those at least thresh apart."""
    mark = "sig_mean_sd" if use_sd else "sig_mean"
    order = Window.partitionBy("taxon").orderBy("seq")
    p = peaks.withColumn("trough", F.when(F.lead("kind").over(order) == "trough", F.lead("t").over(order))).where((F.col("kind") == "peak") & F.col(mark))
    p = p.withColumns({"last": F.lag("t").over(order), "cut": F.lag("trough").over(order)})
    if isinstance(thresh, DataFrame):
        taxon, value = thresh.columns[:2]
        p = p.join(thresh.select(F.col(taxon).alias("taxon"), F.col(value).cast("double").alias("thresh")), "taxon")
    else:
        if thresh <= 0:
            raise ValueError("thresh is above 0")
        p = p.withColumn("thresh", F.lit(float(thresh)))
    return p.groupBy("taxon").agg(F.count("*").alias("pre"), F.collect_list(F.when(F.col("last") - F.col("t") >= F.col("thresh"), F.col("cut"))).alias("cuts"))


def threshold_peaks(df: DataFrame, peaks: DataFrame, rank: str = "genus", srt: str = "max_ma", end: str = "min_ma", thresh: float | DataFrame = 15, use_sd: bool = True) -> tuple[DataFrame, DataFrame]:
    """(df with a column split, comparison): occurrences sliced at the troughs between peaks at least thresh apart.

    split is taxon_g/n: g counts slices from the young end, by the middle of the range, n is the highest
    that the taxon has. Rows without a taxon or an age keep their taxon. comparison: taxon, pre (peaks), post (slices).
    Columns of df stay; split gets underscores behind it if df has one already. An empty table gives empty results.
    """
    cut = breaks(peaks, thresh, use_sd)
    name, cuts, g, key, n, split = fresh(df, "name", "cuts", "g", "key", "n", "split")
    taxon, mid = F.col(rank).cast("string"), F.col(srt) - (F.col(srt) - F.col(end)) / 2
    joined = df.join(cut.select(F.col("taxon").alias(name), F.col("cuts").alias(cuts)), taxon == F.col(name), "left")
    slot = F.size(F.filter(cuts, lambda b: b < mid)) + 1
    sliced = joined.withColumn(g, F.when(F.col(cuts).isNotNull() & mid.isNotNull(), slot))
    top = sliced.where(F.col(g).isNotNull()).groupBy(taxon.alias(key)).agg(F.max(g).alias(n))
    named = sliced.join(top, taxon == F.col(key), "left")
    label = F.when(F.col(g).isNotNull(), F.concat(taxon, F.lit("_"), F.col(g).cast("string"), F.lit("/"), F.col(n).cast("string"))).otherwise(taxon)
    data = named.select(*[F.col(c) for c in df.columns], label.alias(split))
    return data, cut.select("taxon", "pre", (F.size("cuts") + 1).alias("post"))


def threshold_ranges(df: DataFrame, rank: str = "genus", srt: str = "max_ma", end: str = "min_ma", method: str = "kernel", step: int = 1, density: float = 0.1, use_sd: bool = True, win: int = 5, thresh: float | DataFrame = 5, bw: str | float = "nrd0", adjust: float = 1.0, kernel: str = "gaussian") -> ThresholdResult:
    """Taxa split at the troughs between distant peaks of their density: data, the density matrix (taxon, t, value), peaks and comparison."""
    require(df, rank)
    require_number(df, srt, end)
    value = "kdensity" if method == "kernel" else "hist"
    whole = df.dropna(subset=[rank, srt, end])
    matrix = densify(whole, rank, srt, end, step, density, method, bw=bw, adjust=adjust, kernel=kernel)
    peaks = find_peaks(matrix, value, win, step)
    data, comparison = threshold_peaks(df, peaks, rank, srt, end, thresh, use_sd)
    return ThresholdResult(data, matrix.withColumnRenamed(value, "value"), peaks, comparison)
