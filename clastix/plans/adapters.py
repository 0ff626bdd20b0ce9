"""The driver's tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    folder = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(folder).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return source.parquet(folder) if whole else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(df: DataFrame) -> DataFrame:
    """A stream read to its end, its rows as a table of the shared folder."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences: order lines as finds of parts."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_partkey").cast("string").alias("genus"),
        F.col("l_orderkey").alias("collection_no"),
        (F.col("l_quantity") + 50 * F.col("l_discount")).cast("double").alias("max_ma"),
        F.col("l_quantity").cast("double").alias("min_ma"),
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
        "l_returnflag",
    )


OCC = """occ AS (SELECT CAST(l_partkey AS VARCHAR) AS genus, l_orderkey AS collection_no, CAST(l_quantity + 50 * l_discount AS DOUBLE) AS max_ma,
  CAST(l_quantity AS DOUBLE) AS min_ma, l_linenumber, l_suppkey, l_extendedprice, l_returnflag FROM lineitem)"""


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occ(spark, sf_dir).where("l_returnflag = 'R' AND l_linenumber = 1")


REF = OCC + """,
ref AS (SELECT genus, max(max_ma) AS f, min(min_ma) AS l FROM occ WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY genus)"""


def occ_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of few taxa: brands instead of parts."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("p_brand").alias("genus"), (F.col("l_quantity") + 50 * F.col("l_discount")).cast("double").alias("max_ma"), F.col("l_quantity").cast("double").alias("min_ma"))


OCC_BRAND = """occ AS (SELECT p_brand AS genus, CAST(l_quantity + 50 * l_discount AS DOUBLE) AS max_ma, CAST(l_quantity AS DOUBLE) AS min_ma
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict hierarchy: region, nation, supplier."""
    s, n, r = (table(spark, sf_dir, k) for k in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("class"), F.col("n_name").alias("order"), F.col("s_name").alias("family"))


TREE = """h AS (SELECT r_name AS "class", n_name AS "order", s_name AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that contradict one another: type, brand and name of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("class"), F.col("p_brand").alias("order"), F.col("p_name").alias("family"))


CONFLICT = """h AS (SELECT p_type AS "class", p_brand AS "order", p_name AS family FROM part)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all lines of all documents as terms, in groups by language."""
    line = F.explode(F.split(F.lower("text"), "\n"))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("groups"), line.alias("line"))
    return d.select("groups", F.regexp_extract("line", "[a-z]+", 0).alias("terms")).where(F.length("terms").between(4, 12))


VOCABULARY = """v AS (SELECT groups, terms FROM (SELECT groups, regexp_extract(line, '[a-z]+') AS terms FROM (SELECT lang AS groups, unnest(string_split(lower(text), chr(10))) AS line FROM documents)) WHERE length(terms) BETWEEN 4 AND 12)"""


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families (200 of them, of orders) below two orders of one class, below one order with gaps, or below several: 0, 1, 2 of kind."""
    k, h = F.col("o_custkey") % 200, F.col("o_orderkey") % 5
    one = lambda j: F.concat(F.lit("Ord"), F.translate((k % 8).cast("string"), "01234567", "bcdfghjk"), F.lit("o"), F.translate(j.cast("string"), "01234", "npqrs"), F.lit("ales"))
    order = F.when(k % 3 == 0, one(F.when(h < 3, 1).otherwise(2))).when((k % 3 == 1) & (h < 2), None).when(k % 3 == 1, one(F.lit(1))).otherwise(one(h % 4))
    name = F.translate(F.lpad(k.cast("string"), 3, "0"), "012", "BCD").substr(1, 1)
    family = F.concat(name, F.translate((k / 10).cast("int") % 10, "0123456789", "npqrstvwxz"), F.lit("o"), F.translate(k % 10, "0123456789", "bcdfghjklm"), F.lit("idae"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Class"), F.translate((k % 8).cast("string"), "01234567", "bcdfghjk")).alias("class"), order.alias("order"), family.alias("family"))


TANGLED = """o AS (SELECT o_orderkey, o_custkey % 200 AS k, o_orderkey % 5 AS h FROM orders),
q AS (SELECT *, translate(CAST(k % 8 AS VARCHAR), '01234567', 'bcdfghjk') AS c, CASE WHEN k % 3 = 0 THEN CASE WHEN h < 3 THEN 1 ELSE 2 END WHEN k % 3 = 1 AND h >= 2 THEN 1 WHEN k % 3 = 2 THEN h % 4 END AS j,
  translate(left(lpad(CAST(k AS VARCHAR), 3, '0'), 1), '012', 'BCD') || translate(CAST(k // 10 % 10 AS VARCHAR), '0123456789', 'npqrstvwxz') || 'o' || translate(CAST(k % 10 AS VARCHAR), '0123456789', 'bcdfghjklm') || 'idae' AS family FROM o),
x AS (SELECT o_orderkey, 'Class' || c AS "class", 'Ord' || c || 'o' || translate(CAST(j AS VARCHAR), '01234', 'npqrs') || 'ales' AS "order", family FROM q)"""
#: x with its conflicts resolved: of two orders the commoner, a gap filled, a letter for each of three parents or more.
RESOLVED = """l AS (SELECT "class", "order", family, count(*) AS n FROM x GROUP BY ALL),
f AS (SELECT family, count("order") AS orders, CAST(bool_or("order" IS NULL) AS INTEGER) AS gap, arg_min("order", (-n, "order")) FILTER ("order" IS NOT NULL) AS best FROM l GROUP BY family),
m AS (SELECT "class" AS c0, "order" AS o0, family, row_number() OVER (PARTITION BY family ORDER BY "order" IS NULL, "order") AS k FROM l),
y AS (SELECT o_orderkey, "class", CASE WHEN orders + gap = 2 THEN best ELSE "order" END AS "order", CASE WHEN orders + gap > 2 THEN x.family || chr(CAST(64 + k AS INTEGER)) ELSE x.family END AS family
  FROM x JOIN f USING (family) JOIN m ON m.family = x.family AND m.o0 IS NOT DISTINCT FROM x."order")"""
