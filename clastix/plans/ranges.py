"""Queries of ages and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ages, intervals
from . import adapters as A
from .registry import ORACLES, QUERIES, Query

X = ("genus", "max_ma", "min_ma")
ORDER = ["l_linenumber", "genus", "l_suppkey", "l_extendedprice", "max_ma", "min_ma"]


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


_ENDS = f"""WITH {A.OCC}, e AS (SELECT DISTINCT genus AS taxon, max_ma + CAST(0.1 AS DOUBLE) AS adj, 1 AS s, max_ma AS age FROM occ UNION SELECT DISTINCT genus, min_ma, 0, min_ma FROM occ),
k AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY adj DESC, s DESC) AS k, count(*) OVER (PARTITION BY taxon) AS n FROM e),
b AS (SELECT taxon, max(age) FILTER (k = 1) AS FAD_early, max(age) FILTER (k = 2) AS FAD_late, max(age) FILTER (k = n - 1) AS LAD_early, max(age) FILTER (k = n) AS LAD_late FROM k GROUP BY taxon)
"""


@query("age_ranges_max", f"WITH {A.OCC} SELECT genus AS taxon, max(max_ma) AS FAD, min(min_ma) AS LAD, 'genus' AS level FROM occ GROUP BY genus")
def age_ranges_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.age_ranges(A.occ(spark, sf_dir), validate=False)


@query("age_ranges_min", _ENDS + "SELECT taxon, FAD_late AS FAD, LAD_early AS LAD, 'genus' AS level FROM b")
def age_ranges_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.age_ranges(A.occ(spark, sf_dir), mode="min", validate=False)


@query("age_ranges_bounds", _ENDS + "SELECT *, 'genus' AS level FROM b")
def age_ranges_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.age_ranges(A.occ(spark, sf_dir), mode="bounds", validate=False)


@query("age_ranges_multirank", f"""WITH {A.OCC} SELECT genus AS taxon, max(max_ma) AS FAD, min(min_ma) AS LAD, 'genus' AS level FROM occ GROUP BY genus
UNION ALL SELECT l_returnflag, max(max_ma), min(min_ma), 'l_returnflag' FROM occ GROUP BY l_returnflag""")
def age_ranges_multirank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.age_ranges(A.occ(spark, sf_dir), ["genus", "l_returnflag"], validate=False)


_SCALE = [("ECONOMY", 23.0, 5.3), ("STANDARD", 66.0, 23.0), ("PROMO", 145.0, 66.0), ("SMALL", 201.4, 145.0), ("MEDIUM", 251.9, 201.4)]
_NAMES = ", ".join(f"('{a}', {b}, {c})" for a, b, c in _SCALE)


@query("chrono_scale", f"""WITH t(i, f, l) AS (VALUES {_NAMES}), p AS (SELECT p_partkey, p_type AS e, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'PROMO' ELSE p_type END AS y, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part),
j AS (SELECT p_partkey, coalesce(x.f, a) AS f, coalesce(z.l, b) AS l FROM p LEFT JOIN t x ON x.i = e LEFT JOIN t z ON z.i = coalesce(y, e))
SELECT p_partkey, CAST(CASE WHEN f IS NOT NULL AND l IS NOT NULL THEN greatest(f, l) END AS DOUBLE) AS "newFAD", CAST(CASE WHEN f IS NOT NULL AND l IS NOT NULL THEN least(f, l) END AS DOUBLE) AS "newLAD" FROM j""")
def chrono_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, A.table(spark, sf_dir, "part"))


def _dated(spark: SparkSession, part: DataFrame) -> DataFrame:
    size = F.col("p_size") % 3
    x = part.select("p_partkey", F.col("p_type").alias("e"), F.when(size == 0, None).when(size == 1, "PROMO").otherwise(F.col("p_type")).alias("y"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    scale = spark.createDataFrame(_SCALE, "Interval string, FAD double, LAD double")
    return ages.chrono_scale(x, scale, "e", "y", "a", "b").select("p_partkey", "newFAD", "newLAD")


@query("chrono_scale_stream", ORACLES["chrono_scale"])
def chrono_scale_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drained(_dated(spark, A.stream(spark, sf_dir, "part")))


@query("unmatched_intervals", f"WITH t(i, f, l) AS (VALUES {_NAMES}) SELECT DISTINCT p_type AS interval FROM part WHERE p_type NOT IN (SELECT i FROM t)")
def unmatched_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("e"), F.col("p_type").alias("y"))
    return ages.unmatched_intervals(x, spark.createDataFrame(_SCALE, "Interval string, FAD double, LAD double"), "e", "y")


_ANIMALS, _PLANTS, _PROTISTS = ["ECONOMY", "PROMO"], ["STANDARD", "PROMO"], ["SMALL", "ECONOMY"]


@query("add_kingdoms", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Protista' WHEN p_type IN ('STANDARD', 'PROMO') THEN 'Plantae' END AS kingdom, p_type AS phylum FROM part")
def add_kingdoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(A.table(spark, sf_dir, "part"))


@query("add_kingdoms_stream", ORACLES["add_kingdoms"])
def add_kingdoms_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drained(_ruled(A.stream(spark, sf_dir, "part")))


def _ruled(part: DataFrame) -> DataFrame:
    x = part.select("p_partkey", F.col("p_type").alias("phylum"))
    return ages.add_kingdoms(x, {"Animalia": _ANIMALS, "Plantae": _PLANTS, "Protista": _PROTISTS})


_CODE = """CASE WHEN f IS NULL THEN '000' WHEN max_ma <= f AND min_ma >= l THEN 'R1R' WHEN min_ma < l AND max_ma > f THEN '0R0' WHEN max_ma > f AND min_ma > f THEN '00R'
  WHEN min_ma < l AND max_ma < l THEN 'R00' WHEN min_ma >= l AND min_ma <= f AND max_ma > f THEN '0R1' ELSE '1R0' END AS code"""
_FLAGS = f"WITH {A.REF}, c AS (SELECT occ.*, f, l, {_CODE} FROM occ LEFT JOIN ref USING (genus))"


@query("flag_ranges_occurrence", _FLAGS + """, d AS (SELECT *, CASE WHEN code IN ('0R0', '00R', '0R1') THEN max_ma - f END AS fd, CASE WHEN code IN ('0R0', 'R00', '1R0') THEN l - min_ma END AS ld FROM c)
SELECT genus, collection_no, l_linenumber, max_ma, min_ma, code AS status, round(fd, 2) AS fad_diff, round(ld, 2) AS lad_diff, CAST(coalesce(fd >= 5, false) AS INTEGER) AS fad_flag_5, CAST(coalesce(ld >= 5, false) AS INTEGER) AS lad_flag_5 FROM d""")
def flag_ranges_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.flag_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X).occurrence
    return out.select("genus", "collection_no", "l_linenumber", "max_ma", "min_ma", "status", "fad_diff", "lad_diff", "fad_flag_5", "lad_flag_5")


@query("flag_ranges_counts", _FLAGS + " SELECT code AS status, count(*) AS n FROM c GROUP BY code")
def flag_ranges_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.flag_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X).occurrence.groupBy("status").agg(F.count("*").alias("n"))


_N = ", ".join(f"CAST(count(*) FILTER (code = '{'R1R' if k == '1R1' else k}') AS BIGINT) AS \"n_{k}\"" for k in intervals.COUNTED)


@query("flag_ranges_taxon", _FLAGS + f""", t AS (SELECT genus AS taxon, {_N}, max(max_ma) AS m, min(min_ma) AS n, max(f) AS f, max(l) AS l FROM c GROUP BY genus)
SELECT taxon, CASE WHEN f IS NULL THEN '000' WHEN "n_0R0" > 0 OR ("n_00R" > 0 AND "n_R00" > 0) OR ("n_00R" > 0 AND "n_1R0" > 0) THEN '0R0' WHEN "n_00R" > 0 THEN '00R' WHEN "n_R00" > 0 AND "n_0R1" > 0 THEN '0R0' WHEN "n_R00" > 0 THEN 'R00'
  WHEN "n_0R1" > 0 AND "n_1R0" > 0 THEN '0R0' WHEN "n_0R1" > 0 THEN '0R1' WHEN "n_1R0" > 0 THEN '1R0' ELSE 'R1R' END AS status, {", ".join(f'"n_{k}"' for k in intervals.COUNTED)},
  round(CASE WHEN m > f THEN m - f END, 2) AS fad_diff, round(CASE WHEN l > n THEN l - n END, 2) AS lad_diff FROM t""")
def flag_ranges_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.flag_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X).taxon


@query("intersect_ranges", f"""WITH {A.OCC}, e AS (SELECT collection_no, v, o, sum(d) AS d FROM (SELECT collection_no, min_ma AS v, 0 AS o, 1 AS d FROM occ UNION ALL SELECT collection_no, max_ma, 1, -1 FROM occ) GROUP BY 1, 2, 3),
s AS (SELECT *, sum(d) OVER w AS n, lead(v) OVER w AS ub FROM e WINDOW w AS (PARTITION BY collection_no ORDER BY v, o))
SELECT collection_no, v AS lb, ub, CAST(n AS BIGINT) AS "N" FROM s WHERE o = 0 QUALIFY n = max(n) OVER (PARTITION BY collection_no)""")
def intersect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect_ranges(A.occ(spark, sf_dir), by=["collection_no"])


def _revision(prop: float) -> str:
    first = ", ".join(ORDER)
    return f"""WITH {A.REF}, h AS (SELECT occ.*, f, l, {_CODE} FROM occ LEFT JOIN ref USING (genus)),
i AS (SELECT collection_no, bool_or(code NOT IN ('000', 'R1R')) AS work FROM h GROUP BY 1),
o AS (SELECT collection_no, max_ma AS s0, min_ma AS e0 FROM h QUALIFY row_number() OVER (PARTITION BY collection_no ORDER BY {first}) = 1),
foo AS (SELECT DISTINCT h.collection_no, genus, max_ma, min_ma, f, l FROM h JOIN i USING (collection_no) WHERE work AND f IS NOT NULL),
b AS (SELECT DISTINCT collection_no, unnest([f, l]) AS b FROM foo),
n AS (SELECT b.collection_no, b, count(*) FILTER (l <= b AND f >= b) / count(*) AS p FROM b JOIN foo USING (collection_no) GROUP BY 1, 2),
r AS (SELECT collection_no, max(b) AS rf, min(b) AS rl, max(p) AS m FROM (SELECT *, max(p) OVER (PARTITION BY collection_no) AS top FROM n) WHERE p = top GROUP BY 1),
g AS (SELECT *, CASE WHEN NOT work OR m IS NULL THEN 'Unchecked' WHEN m < {prop} THEN 'Unresolved' WHEN rf >= s0 AND rl <= e0 THEN 'Retained' ELSE 'Revised' END AS revision, rf >= e0 AND rl <= s0 AS meets FROM i JOIN o USING (collection_no) LEFT JOIN r USING (collection_no)),
z AS (SELECT collection_no, revision, CASE WHEN revision <> 'Revised' THEN s0 WHEN meets THEN least(rf, s0) ELSE rf END AS nf, CASE WHEN revision <> 'Revised' THEN e0 WHEN meets THEN greatest(rl, e0) ELSE rl END AS nl,
  CASE revision WHEN 'Retained' THEN 1.0::DOUBLE WHEN 'Revised' THEN m END AS prop FROM g),
t AS (SELECT h.*, revision, prop, revision IN ('Revised', 'Retained') AS chg, nf, nl FROM h JOIN z USING (collection_no)),
q AS (SELECT *, CASE WHEN chg AND prop < 1 AND f <= nl AND l < nl THEN 'R00' WHEN chg AND prop < 1 AND f > nf AND l >= nf THEN '00R' WHEN chg AND prop = 1 THEN 'R1R' ELSE '000' END AS tax_flag FROM t)
"""


@query("revise_ranges_collection", _revision(0.75) + """SELECT z.collection_no AS assemblage, nf AS "FAD", nl AS "LAD", z.revision, CASE WHEN z.revision IN ('Unchecked', 'Unresolved') THEN '000' WHEN z.prop = 1 THEN 'R1R' WHEN o AND r THEN '0R0' WHEN o THEN '00R' WHEN r THEN 'R00' ELSE '000' END AS status, round(z.prop, 6) AS prop
FROM z JOIN (SELECT collection_no, bool_or(tax_flag = '00R') AS o, bool_or(tax_flag = 'R00') AS r FROM q GROUP BY 1) USING (collection_no)""")
def revise_ranges_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.revise_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X, "collection_no", ORDER, do_flag=True).collection
    return out.withColumn("prop", F.round("prop", 6))


@query("revise_ranges_occurrence", _revision(0.5) + """SELECT genus, collection_no, l_linenumber, max_ma, min_ma, CASE WHEN chg THEN nf ELSE max_ma END AS "FAD", CASE WHEN chg THEN nl ELSE min_ma END AS "LAD",
  CASE WHEN tax_flag = '00R' THEN abs(nf - max_ma) END AS "FAD_diff", CASE WHEN tax_flag = 'R00' THEN abs(nl - min_ma) END AS "LAD_diff", tax_flag FROM q""")
def revise_ranges_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.revise_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X, "collection_no", ORDER, do_flag=True, prop=0.5).occurrence
    return out.select("genus", "collection_no", "l_linenumber", "max_ma", "min_ma", "tax_flag", "FAD", "LAD", "FAD_diff", "LAD_diff")


@query("intersect_ranges_whole", f"""WITH {A.OCC}, e AS (SELECT v, o, sum(d) AS d FROM (SELECT min_ma AS v, 0 AS o, 1 AS d FROM occ UNION ALL SELECT max_ma, 1, -1 FROM occ) GROUP BY 1, 2),
s AS (SELECT *, sum(d) OVER w AS n, lead(v) OVER w AS ub FROM e WINDOW w AS (ORDER BY v, o)) SELECT v AS lb, ub, CAST(n AS BIGINT) AS "N" FROM s WHERE o = 0 QUALIFY n = max(n) OVER ()""")
def intersect_ranges_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect_ranges(A.occ(spark, sf_dir))


@query("revise_ranges_err", _revision(0.75).replace(f"{_CODE} FROM occ", "CASE WHEN l_returnflag = 'A' THEN '0R1' ELSE '000' END AS code FROM occ") + """SELECT collection_no AS assemblage, nf AS "FAD", nl AS "LAD", revision, round(prop, 6) AS prop FROM z""")
def revise_ranges_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the error codes of a column in place of those of flag_ranges()."""
    x = A.occ(spark, sf_dir).withColumn("e", F.when(F.col("l_returnflag") == "A", "0R1").otherwise("000"))
    out = intervals.revise_ranges(x, A.ref(spark, sf_dir), X, "collection_no", ORDER, err="e").collection
    return out.withColumn("prop", F.round("prop", 6)).drop("status")


_PAIRED = _revision(0.5).replace(
    "r AS (SELECT collection_no, max(b) AS rf, min(b) AS rl, max(p) AS m FROM (SELECT *, max(p) OVER (PARTITION BY collection_no) AS top FROM n) WHERE p = top GROUP BY 1)",
    "two AS (SELECT collection_no, max(b) AS rf, min(b) AS rl, avg(p) AS m2, count(*) AS c FROM (SELECT * FROM n WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY collection_no ORDER BY p DESC, b DESC) <= 2) GROUP BY 1),\n"
    "r AS (SELECT collection_no, rf, rl, coalesce(m2, m0) AS m, m0, coalesce(c, 0) AS c FROM (SELECT collection_no, max(p) AS m0 FROM n GROUP BY 1) LEFT JOIN two USING (collection_no))",
).replace("WHEN m < 0.5 THEN", "WHEN m0 < 0.5 OR c <> 2 THEN").replace("rf >= e0 AND rl <= s0 AS meets", "rf > e0 AND rl < s0 AS meets")


@query("revise_ranges_paired", _PAIRED + """SELECT collection_no AS assemblage, nf AS "FAD", nl AS "LAD", revision, round(prop, 6) AS prop FROM z""")
def revise_ranges_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without solutions of length zero."""
    out = intervals.revise_ranges(A.occ(spark, sf_dir), A.ref(spark, sf_dir), X, "collection_no", ORDER, do_flag=True, prop=0.5, allow_zero=False).collection
    return out.withColumn("prop", F.round("prop", 6)).drop("status")
