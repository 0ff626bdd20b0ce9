"""Queries of densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density
from . import adapters as A
from .ranges import query

D = "CAST(0.1 AS DOUBLE)"
POINTS = f"""WITH {A.OCC_BRAND}, pts AS (SELECT genus AS taxon, greatest(s - k * {D}, e) AS p FROM (SELECT genus, max_ma + {D} AS s, min_ma AS e, unnest(range(0, CAST(floor((max_ma + {D} - min_ma) / {D} + 1e-10) AS INTEGER) + 1)) AS k FROM occ)),
t AS (SELECT taxon, floor(min(p)) AS a, ceil(max(p)) AS z, CAST(ceil(max(p)) - floor(min(p)) AS INTEGER) AS n, count(*) AS N_, 0.9 * least(stddev_samp(p), (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM pts GROUP BY 1),
b AS (SELECT taxon, CAST(greatest(1, ceil(p - a - 1e-7)) AS INTEGER) AS bin, count(*) AS c FROM pts JOIN t USING (taxon) GROUP BY 1, 2),
w AS (SELECT taxon, p, count(*) AS w FROM pts GROUP BY 1, 2)"""
KERNEL = """, g AS (SELECT *, a + (bin - 1) * ((z - a) / (n - 1)) AS x FROM (SELECT *, unnest(range(1, n + 1)) AS bin FROM t)),
k AS (SELECT taxon, bin, x, sum(w * exp(-0.5 * ((x - p) / bw) * ((x - p) / bw))) / (any_value(N_) * any_value(bw) * sqrt(2 * pi())) AS y FROM g JOIN w USING (taxon) GROUP BY 1, 2, 3)"""


@query("densify_hist", POINTS + f" SELECT taxon, CAST(a + bin AS DOUBLE) AS t, CAST(ceil(c / (1 / {D})) AS BIGINT) AS hist FROM b JOIN t USING (taxon)")
def densify_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.densify(A.occ_brand(spark, sf_dir), method="histogram")


@query("densify_kde", POINTS + KERNEL + " SELECT taxon, CAST(a + bin AS DOUBLE) AS t, round(y, 8) AS kdensity FROM k JOIN b USING (taxon, bin) JOIN t USING (taxon)")
def densify_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.densify(A.occ_brand(spark, sf_dir), method="kernel").withColumn("kdensity", F.round("kdensity", 8))


_TAIL = """, r AS (SELECT genus AS taxon, max(max_ma) AS f, min(min_ma) AS l FROM occ GROUP BY 1),
x AS (SELECT taxon, f, l, CASE WHEN hi > f OR f - hi <= 1 THEN f ELSE hi END AS h, CASE WHEN lo < l OR lo - l <= 1 THEN l ELSE lo END AS o FROM r JOIN cut USING (taxon))
SELECT taxon, f AS "FAD", l AS "LAD", h AS "FAD95", o AS "LAD95", CASE WHEN f > l THEN CAST(((f - h) + (o - l)) / abs(f - l) >= 0.35 AS INTEGER) END AS tflag0_35 FROM x"""


@query("pacmacro_hist", POINTS + """, k AS (SELECT taxon, bin, sum(c) OVER (PARTITION BY taxon ORDER BY bin DESC) >= sum(c) OVER (PARTITION BY taxon) * 5 / 100 AS o, sum(c) OVER (PARTITION BY taxon ORDER BY bin) >= sum(c) OVER (PARTITION BY taxon) * 5 / 100 AS y FROM b),
cut AS (SELECT taxon, CAST(max(a + bin) AS DOUBLE) AS hi, CAST(min(a + bin) AS DOUBLE) AS lo FROM k JOIN t USING (taxon) WHERE o AND y GROUP BY 1)""" + _TAIL)
def pacmacro_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.pacmacro_ranges(A.occ_brand(spark, sf_dir))


_QUANTILES = """, m AS (SELECT k.taxon, x, CASE WHEN c IS NULL THEN 0 ELSE y END AS y FROM k LEFT JOIN b USING (taxon, bin)),
s AS (SELECT *, sum(y) OVER v - (y - first_value(y) OVER v) / 2 AS c0 FROM m WINDOW v AS (PARTITION BY taxon ORDER BY x)),
n1 AS (SELECT taxon, x, c0 / last_value(c0) OVER (PARTITION BY taxon ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM s),
n2 AS (SELECT *, lead(c) OVER v AS c2, lead(x) OVER v AS x2 FROM n1 WINDOW v AS (PARTITION BY taxon ORDER BY x)),
q AS (SELECT taxon, max(CASE WHEN c <= 0.95 AND c2 > 0.95 THEN x + (0.95 - c) / (c2 - c) * (x2 - x) END) AS hi, max(CASE WHEN c <= 0.05 AND c2 > 0.05 THEN x + (0.05 - c) / (c2 - c) * (x2 - x) END) AS lo, min(c) > 0.05 AS below FROM n2 GROUP BY 1)"""


@query("density_quantiles", POINTS + KERNEL + _QUANTILES + " SELECT taxon, round(hi, 6) AS q0, round(CASE WHEN below THEN CAST('-inf' AS DOUBLE) ELSE lo END, 6) AS q1 FROM q")
def density_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = density.points(A.occ_brand(spark, sf_dir), "genus", "max_ma", "min_ma", 0.1)
    t, bins = density._binned(pts, 1)
    grid = density._kernel(pts, t).join(bins, ["taxon", "bin"], "left").join(t.select("taxon", "a", "z", "n"), "taxon")
    grid = grid.select("taxon", (F.col("a") + (F.col("bin") - 1) * ((F.col("z") - F.col("a")) / (F.col("n") - 1))).alias("x"), F.when(F.col("c").isNull(), 0.0).otherwise(F.col("y")).alias("y"))
    q = density.quantiles(grid, [0.95, 0.05])
    return q.withColumns({c: F.round(c, 6) for c in ("q0", "q1")})


@query("pacmacro_kde", POINTS + KERNEL + _QUANTILES + ", cut AS (SELECT taxon, coalesce(ceil(hi), CAST('inf' AS DOUBLE)) AS hi, coalesce(floor(lo), CAST('-inf' AS DOUBLE)) AS lo FROM q)" + _TAIL)
def pacmacro_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.pacmacro_ranges(A.occ_brand(spark, sf_dir), method="kernel")


@query("density_profile", POINTS + """, h AS (SELECT taxon, a + bin AS t, CAST(ceil(c / (1 / CAST(0.1 AS DOUBLE))) AS BIGINT) AS hist FROM b JOIN t USING (taxon) WHERE taxon = 'Brand#17'),
s AS (SELECT unnest(range(CAST(min(t) AS BIGINT), CAST(max(t) AS BIGINT) + 1)) AS t FROM h) SELECT 'Brand#17' AS taxon, CAST(s.t AS DOUBLE) AS t, coalesce(hist, 0) AS hist FROM s LEFT JOIN h ON h.t = s.t""")
def density_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_profile(density.densify(A.occ_brand(spark, sf_dir), method="histogram"), "Brand#17")


_TRIANGLE = KERNEL.replace("sum(w * exp(-0.5 * ((x - p) / bw) * ((x - p) / bw))) / (any_value(N_) * any_value(bw) * sqrt(2 * pi()))", "sum(w * greatest(0, 1 - abs(x - p) / (4 * sqrt(6)))) / (any_value(N_) * 4 * sqrt(6))")


@query("densify_triangular", POINTS + _TRIANGLE + " SELECT taxon, CAST(a + bin AS DOUBLE) AS t, round(y, 8) AS kdensity FROM k JOIN b USING (taxon, bin) JOIN t USING (taxon)")
def densify_triangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangular kernel of given bandwidth."""
    return density.densify(A.occ_brand(spark, sf_dir), method="kernel", kernel="triangular", bw=2.0, adjust=2.0).withColumn("kdensity", F.round("kdensity", 8))
