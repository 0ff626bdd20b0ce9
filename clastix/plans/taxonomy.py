"""Queries of the whole taxonomic check, of the source's addresses and of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..shared import shared_dir
from ..sources import occurrences
from ..streaming import flags
from . import adapters as A
from .ranges import _CODE, X, query

_RANKS = ["class", "order", "family"]


def _soiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tangled families, some in small letters, with a remark in brackets, or with an e too many."""
    x, n = A.tangled(spark, sf_dir), F.col("o_orderkey")
    name = F.when(n % 11 == 0, F.concat("family", F.lit("e"))).when(n % 7 == 0, F.concat("family", F.lit(" (x)"))).when(n % 13 == 0, F.lower("family")).otherwise(F.col("family"))
    return x.withColumn("family", name)


#: The rarer of a family and its misspelling is replaced by the other if an order has both; equally common ones stay.
_SPELLED = """s AS (SELECT o_orderkey, "class", "order", CASE WHEN o_orderkey % 11 = 0 THEN family || 'e' ELSE family END AS family FROM x),
n AS (SELECT family, count(*) AS f FROM s GROUP BY 1),
p AS (SELECT DISTINCT a.family AS t1, a."order" AS g FROM s a JOIN s b ON a."order" = b."order" AND b.family = a.family || 'e'),
w AS (SELECT t1, t1 || 'e' AS t2, g, u.f AS freq1, v.f AS freq2 FROM p JOIN n u ON u.family = t1 JOIN n v ON v.family = t1 || 'e'),
r AS (SELECT DISTINCT CASE WHEN freq1 < freq2 THEN t1 ELSE t2 END AS old, CASE WHEN freq1 < freq2 THEN t2 ELSE t1 END AS new FROM w WHERE freq1 <> freq2)"""
_WHOLE = {"clean_name": True, "clean_spell": True, "resolve_duplicates": True}


@query("check_taxonomy", f"WITH {A.TANGLED}, {_SPELLED}, {A.RESOLVED.replace('FROM x GROUP BY ALL', 'FROM z GROUP BY ALL').replace('FROM x JOIN f', 'FROM z AS x JOIN f').replace('l AS (SELECT', 'z AS (SELECT o_orderkey, \"class\", \"order\", coalesce(new, family) AS family FROM s LEFT JOIN r ON old = family), l AS (SELECT', 1)} " + """SELECT o_orderkey, "class", "order", family FROM y""")
def check_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.check_taxonomy(_soiled(spark, sf_dir), _RANKS, "o_orderkey", **_WHOLE).data


@query("check_taxonomy_formatting", f"""WITH {A.TANGLED} SELECT t AS "check", 'family' AS rank, o_orderkey AS row_id FROM x, (VALUES ('non_letter'), ('word_count')) AS v(t) WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0""")
def check_taxonomy_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.check_taxonomy(_soiled(spark, sf_dir), _RANKS, "o_orderkey", routine=("format_check",)).formatting


@query("check_taxonomy_synonyms", f"""WITH {A.TANGLED}, {_SPELLED} SELECT 'family' AS level, g AS "group", t1, t2, 0.0::DOUBLE AS m2, freq1, freq2 FROM w""")
def check_taxonomy_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that differ by the letters of one name; names of one length differ by more."""
    found = taxonomy.check_taxonomy(_soiled(spark, sf_dir), _RANKS, "o_orderkey", **_WHOLE).synonyms
    return found.where("level = 'family' AND m2 < 0.05").select("level", "group", "t1", "t2", "m2", "freq1", "freq2")


_URLS = {
    "trilobites": dict(taxon=["Trilobita", "Agnostida"], ex_taxon="Phacopida", interval=(520, 440), res="genus", fields=["class", "coords"]),
    "old": dict(taxon="Rangea", interval=(700, 480)),
    "places": dict(interval=(23.03, 2.58), mode="collection", area=["FR", "DE"], ex_area=["US"], env=["reef"], ex_env=["slope"], litho=["carbonate"], invert_litho=True),
}
_B = occurrences.BASE
_EXPECTED = [
    ("trilobites", _B + "occs/list.csv?base_name=Trilobita,Agnostida ^Phacopida&taxon_reso=genus&max_ma=520&min_ma=440&show=class,coords"),
    ("old", _B + "occs/list.csv?base_name=Rangea&max_ma=700&min_ma=600"),
    ("old", _B + "occs/list.csv?base_name=Rangea&max_ma=600&min_ma=500"),
    ("old", _B + "occs/list.csv?base_name=Rangea&max_ma=500&min_ma=480"),
    ("places", _B + "colls/list.csv?max_ma=23.03&min_ma=2.58&cc=FR,DE,^US&lithology=!carbonate&envtype=reef,^slope"),
]


@query("occurrence_urls", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EXPECTED) + ") AS u(name, url)")
def occurrence_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, u) for k, v in _URLS.items() for u in occurrences.build_urls(**v)], "name string, url string")


@query("flag_ranges_stream", f"WITH {A.REF}, c AS (SELECT occ.*, f, l, {_CODE} FROM occ LEFT JOIN ref USING (genus)) SELECT code AS status, count(*) AS n FROM c GROUP BY code")
def flag_ranges_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of the occurrences, read as a stream to its end."""
    x = A.stream(spark, sf_dir, "lineitem")
    occ = x.select(F.col("l_partkey").cast("string").alias("genus"), (F.col("l_quantity") + 50 * F.col("l_discount")).cast("double").alias("max_ma"), F.col("l_quantity").cast("double").alias("min_ma"))
    flagged = A.drained(flags.flag_stream(occ, A.ref(spark, sf_dir), X).select("status"))
    return flagged.groupBy("status").agg(F.count("*").alias("n"))


_ANIMALS, _PLANTS = ["ECONOMY", "PROMO"], ["STANDARD"]


@query("read_occurrences", """SELECT CAST(p_partkey AS VARCHAR) AS occurrence_no, CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Animalia' WHEN p_type = 'STANDARD' THEN 'Plantae' END END AS kingdom,
  CASE WHEN p_size % 5 <> 0 THEN p_type END AS phylum, CASE WHEN p_type = 'PROMO' THEN 145.0 ELSE p_size + 1 END::DOUBLE AS max_ma, CASE WHEN p_type = 'PROMO' THEN 66.0 ELSE p_size END::DOUBLE AS min_ma FROM part""")
def read_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as two lists of files that overlap, written as a service's downloads are, read again, dated anew and with kingdoms."""
    size = F.col("p_size")
    x = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("occurrence_no"), F.when(size % 5 != 0, F.col("p_type")).alias("phylum"), F.col("p_type").alias("early_interval"), F.lit("").alias("late_interval"), (size + 1).alias("max_ma"), size.alias("min_ma"))
    paths = [f"{shared_dir(spark)}/list-{uuid.uuid4().hex}" for _ in range(2)]
    for path, span in zip(paths, ("min_ma <= 30", "max_ma >= 20")):
        occurrences.write_occurrences(x.where(span), path)
    scale = spark.createDataFrame([("PROMO", 145.0, 66.0)], "Interval string, FAD double, LAD double")
    out = occurrences.read_occurrences(spark, paths, tscale=scale, kingdoms={"Animalia": _ANIMALS, "Plantae": _PLANTS})
    return out.select("occurrence_no", "kingdom", "phylum", "max_ma", "min_ma")


@query("range_stream", f"""WITH {A.OCC} SELECT genus AS taxon, max(max_ma) AS "FAD", min(min_ma) AS "LAD" FROM occ GROUP BY genus""")
def range_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range table of a stream at its end; a row for each taxon."""
    x = A.stream(spark, sf_dir, "lineitem")
    occ = x.select(F.col("l_partkey").cast("string").alias("genus"), (F.col("l_quantity") + 50 * F.col("l_discount")).cast("double").alias("max_ma"), F.col("l_quantity").cast("double").alias("min_ma"))
    name = f"ranges_{uuid.uuid4().hex}"
    flags.range_stream(occ).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
