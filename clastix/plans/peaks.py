"""Queries of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, peaks
from . import adapters as A
from .density import KERNEL, POINTS
from .ranges import query

_HIST = POINTS + """, h AS (SELECT taxon, a + bin AS t, CAST(ceil(c / (1 / CAST(0.1 AS DOUBLE))) AS BIGINT) AS v FROM b JOIN t USING (taxon)),"""
_KDE = POINTS + KERNEL + """, h AS (SELECT taxon, a + bin AS t, y AS v FROM k JOIN b USING (taxon, bin) JOIN t USING (taxon)),"""
_TOPS = """
sp AS (SELECT taxon, unnest(range(CAST(min(t) AS BIGINT), CAST(max(t) AS BIGINT) + 1)) AS t FROM h GROUP BY 1),
de AS (SELECT sp.taxon, CAST(sp.t AS DOUBLE) AS t, coalesce(v, 0) AS v FROM sp LEFT JOIN h ON h.taxon = sp.taxon AND h.t = sp.t),
ix AS (SELECT *, row_number() OVER w AS i, lag(v) OVER w AS lv FROM de WINDOW w AS (PARTITION BY taxon ORDER BY t DESC)),
co AS (SELECT *, coalesce(lag(v) OVER w, 0) AS bv, coalesce(lead(v) OVER w, 0) AS av FROM ix WHERE lv IS NULL OR lv <> v WINDOW w AS (PARTITION BY taxon ORDER BY t DESC)),
ex AS (SELECT taxon, t, v, i, v > bv AS pk, row_number() OVER (PARTITION BY taxon, v > bv ORDER BY t DESC) AS k FROM co WHERE (v > bv AND v > av) OR (v < bv AND v < av)),
li AS (SELECT taxon, list(v ORDER BY t DESC) AS vs FROM de GROUP BY 1),
wi AS (SELECT ex.*, list_transform(range(-5, 6), lambda d: CASE WHEN i + d < 1 OR i + d > len(vs) THEN 0 ELSE vs[i + d] END) AS w FROM ex JOIN li USING (taxon) WHERE pk),
sm AS (SELECT *, list_transform(range(1, 12), lambda j: (w[greatest(1, least(j - 2, 7))] + w[greatest(1, least(j - 2, 7)) + 1] + w[greatest(1, least(j - 2, 7)) + 2] + w[greatest(1, least(j - 2, 7)) + 3] + w[greatest(1, least(j - 2, 7)) + 4]) / 5
  + (2 * w[greatest(1, least(j - 2, 7)) + 4] + w[greatest(1, least(j - 2, 7)) + 3] - w[greatest(1, least(j - 2, 7)) + 1] - 2 * w[greatest(1, least(j - 2, 7))]) / 10 * (j - greatest(1, least(j - 2, 7)) - 2)) AS s FROM wi),
te AS (SELECT *, list_max(s[5:7]) > list_avg(s) AS m0, list_max(s[5:7]) > list_avg(s) + list_stddev_samp(s) AS d0, count(*) OVER (PARTITION BY taxon) AS n, row_number() OVER (PARTITION BY taxon ORDER BY v DESC, t DESC) AS top FROM sm),
pe AS (SELECT taxon, k, t, v, n, n = 1 OR m0 OR (top = 1 AND NOT bool_or(m0) OVER (PARTITION BY taxon)) AS sig_mean, n = 1 OR d0 OR (top = 1 AND NOT bool_or(d0) OVER (PARTITION BY taxon)) AS sig_mean_sd FROM te),
tr AS (SELECT ex.taxon, ex.k, ex.t, ex.v, sig_mean, sig_mean_sd FROM ex JOIN pe ON NOT ex.pk AND ex.taxon = pe.taxon AND ex.k = pe.k WHERE ex.k < n),
allp AS (SELECT taxon, CAST(2 * k - 1 AS INTEGER) AS seq, 'peak' AS kind, t, CAST(v AS DOUBLE) AS value, sig_mean, sig_mean_sd FROM pe UNION ALL SELECT taxon, CAST(2 * k AS INTEGER), 'trough', t, CAST(v AS DOUBLE), sig_mean, sig_mean_sd FROM tr)"""
PEAKS = _HIST + _TOPS


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.find_peaks(density.densify(A.occ_brand(spark, sf_dir), method="histogram"), "hist")


@query("find_peaks", PEAKS + " SELECT * FROM allp")
def find_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir)


@query("peak_counts", PEAKS + """ SELECT taxon, count(*) AS "all", count(*) FILTER (sig_mean_sd) AS mean_sd, count(*) FILTER (sig_mean) AS mean FROM allp WHERE kind = 'peak' GROUP BY 1""")
def peak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peak_counts(_peaks(spark, sf_dir))


@query("peak_overlay", PEAKS + """ SELECT series, t, value FROM (SELECT 'all' AS series, t, value FROM allp WHERE taxon = 'Brand#17' AND kind = 'peak' UNION ALL SELECT 'mean', t, value FROM allp WHERE taxon = 'Brand#17' AND kind = 'peak' AND sig_mean
UNION ALL SELECT 'mean_sd', t, value FROM allp WHERE taxon = 'Brand#17' AND kind = 'peak' AND sig_mean_sd)""")
def peak_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peak_overlay(_peaks(spark, sf_dir), "Brand#17")


_CUTS = """, sg AS (SELECT *, lag(t) OVER w AS lt, lag(seq) OVER w AS ls FROM allp WHERE kind = 'peak' AND sig_mean WINDOW w AS (PARTITION BY taxon ORDER BY seq)),
cu AS (SELECT sg.taxon, count(*) AS pre, coalesce(list(x.t) FILTER (sg.lt - sg.t >= 3), []) AS cuts FROM sg LEFT JOIN allp x ON x.taxon = sg.taxon AND x.seq = sg.ls + 1 GROUP BY 1)"""


@query("threshold_ranges_comparison", PEAKS + _CUTS + " SELECT taxon, pre, CAST(len(cuts) + 1 AS INTEGER) AS post FROM cu")
def threshold_ranges_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.threshold_ranges(A.occ_brand(spark, sf_dir), method="histogram", thresh=3, use_sd=False).comparison


@query("threshold_ranges_data", PEAKS + _CUTS + """, g AS (SELECT genus, max_ma, min_ma, len(list_filter(cuts, lambda c: c < max_ma - (max_ma - min_ma) / 2)) + 1 AS g FROM occ LEFT JOIN cu ON taxon = genus)
SELECT genus, max_ma, min_ma, genus || '_' || g || '/' || max(g) OVER (PARTITION BY genus) AS split FROM g""")
def threshold_ranges_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.threshold_ranges(A.occ_brand(spark, sf_dir), method="histogram", thresh=3, use_sd=False).data


@query("threshold_ranges_kernel", _KDE + _TOPS + _CUTS.replace("sig_mean ", "sig_mean_sd ") + """, sl AS (SELECT genus, len(list_filter(cuts, lambda c: c < max_ma - (max_ma - min_ma) / 2)) + 1 AS g FROM occ LEFT JOIN cu ON taxon = genus),
na AS (SELECT genus || '_' || g || '/' || max(g) OVER (PARTITION BY genus) AS split FROM sl) SELECT split, count(*) AS n FROM na GROUP BY 1""")
def threshold_ranges_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.threshold_ranges(A.occ_brand(spark, sf_dir), thresh=3).data.groupBy("split").agg(F.count("*").alias("n"))


@query("find_peaks_kernel", _KDE + _TOPS + " SELECT taxon, seq, kind, t, round(value, 8) AS value, sig_mean, sig_mean_sd FROM allp")
def find_peaks_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.find_peaks(density.densify(A.occ_brand(spark, sf_dir), method="kernel")).withColumn("value", F.round("value", 8))


@query("threshold_ranges_table", PEAKS + _CUTS.replace(">= 3)", ">= 2 + CAST(substr(sg.taxon, 7) AS INTEGER) % 3)") + " SELECT taxon, pre, CAST(len(cuts) + 1 AS INTEGER) AS post FROM cu")
def threshold_ranges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold for each taxon."""
    x = A.occ_brand(spark, sf_dir)
    by = x.select("genus").distinct().withColumn("thresh", (2 + F.substring("genus", 7, 9).cast("int") % 3).cast("double"))
    return peaks.threshold_ranges(x, method="histogram", thresh=by, use_sd=False).comparison
