"""Queries of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names
from . import adapters as A
from .ranges import query
from .registry import ORACLES


def _clean(x: str, term: str) -> str:
    steps = [(r"(\(+.+\))", ""), (rf"(?i)\b{term}+\b", " "), (r"\b[XVI]+\b|[0-9]", " "), (r"(?i)[a-z]{0,20}\.", " "), ("NO_", ""), (r"[[:punct:]]", " "), (r"\s[A-Z]{1,4}\b|\b[a-z]{1}\b", " "), (r"\s+", " "), ("^ | $", "")]
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


@query("clean_name", f"""WITH n AS (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ' (var. ' || p_type || ')' WHEN 1 THEN ' sp. ' || p_size WHEN 2 THEN ' NO_IV' WHEN 3 THEN ' cfr' WHEN 4 THEN '' ELSE ' a b' END AS x FROM part),
c AS (SELECT p_partkey, x, {_clean("x", "cf")} AS y FROM n), w AS (SELECT p_partkey, x, lower(CASE WHEN len(string_split(y, ' ')) > 2 THEN string_split(y, ' ')[1] ELSE y END) AS y FROM c)
SELECT p_partkey, x AS name, nullif(upper(y[1:1]) || y[2:], '') AS cleaned FROM w""")
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(A.table(spark, sf_dir, "part"))


@query("clean_name_stream", ORACLES["clean_name"])
def clean_name_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drained(_cleaned(A.stream(spark, sf_dir, "part")))


def _cleaned(part: DataFrame) -> DataFrame:
    k = F.col("p_size") % 6
    tail = F.when(k == 0, F.concat(F.lit(" (var. "), "p_type", F.lit(")"))).when(k == 1, F.concat(F.lit(" sp. "), F.col("p_size").cast("string"))).when(k == 2, " NO_IV").when(k == 3, " cfr").when(k == 4, "").otherwise(" a b")
    x = part.select("p_partkey", F.concat("p_name", tail).alias("name"))
    return x.withColumn("cleaned", names.clean_name(F.col("name"), ["cf"], ["NO_"]))


_WORDS = "len(string_split({0}, ' ')) - CASE WHEN string_split({0}, ' ')[-1] = '' THEN 1 ELSE 0 END"


@query("format_check", f"""SELECT 'non_letter' AS "check", 'p_name' AS rank, p_partkey AS row_id FROM part WHERE regexp_matches(p_name, '[^ \\pL]')
UNION ALL SELECT 'non_letter', 'p_brand', p_partkey FROM part WHERE regexp_matches(p_brand, '[^ \\pL]')
UNION ALL SELECT 'word_count', 'p_brand', p_partkey FROM part WHERE {_WORDS.format("p_brand")} <> 1
UNION ALL SELECT 'word_count', 'p_name', p_partkey FROM part WHERE {_WORDS.format("p_name")} <> 2""")
def format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.format_check(A.table(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_partkey", species=True)


@query("format_check_stream", ORACLES["format_check"])
def format_check_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drained(names.format_check(A.stream(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_partkey", species=True))


_WINDOW = """list_min(list_transform(range(0, greatest(0, length(t1) - length(t2)) + 1), lambda i: 1 - len(list_intersect(list_distinct(string_split(substr(t1, i + 1, length(t2)), '')), list_distinct(string_split(t2, ''))))
  / len(list_distinct(list_concat(string_split(substr(t1, i + 1, length(t2)), ''), string_split(t2, ''))))))"""


_PAIRS = f"""WITH {A.VOCABULARY}, d AS (SELECT DISTINCT * FROM v), f AS (SELECT terms, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT a.terms AS t1, b.terms AS t2, a.groups AS g FROM d a JOIN d b ON a.groups = b.groups AND left(a.terms, 1) = left(b.terms, 1) AND a.terms < b.terms WHERE 1 - jaro_similarity(a.terms, b.terms) < 0.1)
SELECT t1, t2, g AS "group", x.n AS freq1, y.n AS freq2, round({{m2}}, 6) AS m2 FROM p JOIN f x ON x.terms = t1 JOIN f y ON y.terms = t2"""


@query("spell_check", _PAIRS.format(m2=_WINDOW) + " WHERE NOT (t1 LIKE '%ing') = NOT (t2 LIKE '%ing')")
def spell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spell_check(A.vocabulary(spark, sf_dir), "terms", "groups", suff=["ing"]).withColumn("m2", F.round("m2", 6))


def _spelled(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return names.spell_check(A.vocabulary(spark, sf_dir), "terms", "groups", **options).withColumn("m2", F.round("m2", 6))


def _least(distance: str) -> str:
    """The least distance of t2 from the stretches w of t1 of its length."""
    each = distance.replace("{w}", "substr(t1, i + 1, length(t2))")
    return f"list_min(list_transform(range(0, greatest(0, length(t1) - length(t2)) + 1), lambda i: {each}))"


_COUNT = "(length({x}) - length(replace({x}, c, '')))"
_LETTERS = "string_split('abcdefghijklmnopqrstuvwxyz', '')"
_OVER = lambda e: f"list_sum(list_transform({_LETTERS}, lambda c: {e}))"
_A, _B = _COUNT.format(x="{w}"), _COUNT.format(x="t2")


@query("spell_check_lv", _PAIRS.format(m2=_least("levenshtein({w}, t2)::DOUBLE")) + " WHERE right(t1, 2) = right(t2, 2)")
def spell_check_lv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir, alternative="lv", str2=2)


@query("spell_check_dl", _PAIRS.format(m2=_least("damerau_levenshtein({w}, t2)::DOUBLE")) + " WHERE g <> 'de'")
def spell_check_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir, alternative="dl", exclude=["de"])


@query("spell_check_hamming", _PAIRS.format(m2=_least("CASE WHEN length({w}) = length(t2) THEN hamming({w}, t2)::DOUBLE ELSE CAST('inf' AS DOUBLE) END")) + " WHERE (t1 LIKE 'th%') = (t2 LIKE 'th%')")
def spell_check_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir, alternative="hamming", pref=["th"])


@query("spell_check_qgram", _PAIRS.format(m2=_least(_OVER(f"abs({_A} - {_B})") + "::DOUBLE")))
def spell_check_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir, alternative="qgram")


@query("spell_check_cosine", _PAIRS.format(m2="greatest(0, " + _least(f"1 - {_OVER(f'{_A} * {_B}')} / sqrt({_OVER(f'{_A} * {_A}')} * {_OVER(f'{_B} * {_B}')})") + ")"))
def spell_check_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir, alternative="cosine")
