"""Names: cleaning, formatting checks, and names that may be misspellings of one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import METHODS, jaro_similarity, letter_mask, window_distance
from ..schema import require, require_text
from ..shared import drop, fresh, written


#: Parts of a block of terms that are compared with the whole block, each in a task.
PARTS = 8


def clean_name(x: Column, terms: list[str] | None = None, collapse: list[str] | None = None) -> Column:
    """A name as one or two words, the first capitalised, the rest small; null if nothing is left.

    Dropped, in this order: what is in brackets, terms (the last letter may repeat), Roman and Arabic
    numerals, abbreviations that end in a full stop, the strings of collapse (regular expressions, without
    a blank in their place), ASCII punctuation, single small letters and groups of up to four capitals.
    Of three words or more the first stays.
    """
    drop = lambda c, pattern, by: F.regexp_replace(c, pattern, by)
    out = drop(x, r"(\(+.+\))", "")
    if terms:
        out = drop(out, "|".join(rf"(?i)\b{t}+\b" for t in terms), " ")
    out = drop(out, r"\b[XVI]+\b|[0-9]", " ")
    out = drop(out, r"(?i)[a-z]{0,20}\.", " ")
    if collapse:
        out = drop(out, "|".join(collapse), "")
    out = drop(out, r"\p{Punct}", " ")
    out = drop(out, r"\s[A-Z]{1,4}\b|\b[a-z]{1}\b", " ")
    out = drop(drop(out, r"\s+", " "), "^ | $", "")
    out = F.lower(drop(out, "^([^ ]+) [^ ]+ .*$", "$1"))
    # the lambda names the chain once: used three times, it would be computed as often
    return F.transform(F.array(out), lambda o: F.when(o != "", F.concat(F.upper(F.substring(o, 1, 1)), F.substr(o, F.lit(2)))))[0]


def clean_names(df: DataFrame, columns: list[str], terms: dict[str, list[str]] | None = None, collapse: dict[str, list[str]] | None = None) -> DataFrame:
    """df with these columns cleaned; terms and collapse by column."""
    require_text(df, *columns)
    return df.withColumns({c: clean_name(F.col(c), (terms or {}).get(c), (collapse or {}).get(c)) for c in columns})


def word_count(x: Column) -> Column:
    """Words between single blanks; a blank at the end begins none, and an empty text has none."""
    parts = F.split(x, " ")
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def format_check(df: DataFrame, ranks: list[str], row_id: str, species: bool = False, species_sep: str = " ") -> DataFrame:
    """(check, rank, row_id): rows whose name at a rank has a character that is no letter, or not one word.

    With species the last rank is a species name: species_sep in it is a blank, it has two words, and
    blanks are allowed in all ranks. Nulls are never flagged.
    """
    require_text(df, *ranks)
    require(df, row_id)
    tests = []
    for k, r in enumerate(ranks):
        last = species and k == len(ranks) - 1
        name = F.replace(F.col(r), F.lit(species_sep), F.lit(" ")) if last and species_sep != " " else F.col(r)
        odd = name.rlike(r"[^ \p{L}]" if species else r"[^\p{L}]")
        tests += [F.struct(F.lit("non_letter").alias("check"), F.lit(r).alias("rank"), odd.alias("bad")), F.struct(F.lit("word_count").alias("check"), F.lit(r).alias("rank"), (word_count(name) != (2 if last else 1)).alias("bad"))]
    return df.select(F.col(row_id).alias("row_id"), F.inline(F.array(*tests))).where("bad").select("check", "rank", "row_id")


def spell_check(
    df: DataFrame,
    terms: str,
    groups: str,
    jw: float = 0.1,
    str_: int | None = 1,
    str2: int | None = None,
    alternative: str = "jaccard",
    q: int = 1,
    pref: list[str] | None = None,
    suff: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """(t1, t2, group, freq1, freq2, m2), t1 < t2: pairs of terms of a group whose Jaro distance is below jw.

    They share their first str_ and last str2 characters, and each of the expressions pref (at the start)
    and suff (at the end) fits both or neither. freq1 and freq2 count the terms in all groups; m2 is the
    least distance by alternative of t2 from the stretches of t1 of its length. Pairs are compared only
    within a group and a beginning, if their lengths and the letters that only one of them has allow the
    distance. A null term counts nowhere, a null group only in freq. An empty table gives no rows.
    """
    require_text(df, terms, groups)
    if alternative not in METHODS:
        raise ValueError(f"alternative is one of {METHODS}")
    rows = df.select(F.col(groups).alias("group"), F.col(terms).alias("t")).where("t IS NOT NULL")
    freq = rows.groupBy("t").agg(F.count("*").alias("f"))
    seen = rows.where("group IS NOT NULL")
    if exclude:
        seen = seen.where(~F.col("group").isin(*exclude))
    block = F.left("t", F.lit(str_)) if str_ else F.lit("")
    seen = seen.distinct().withColumn("block", block)
    seen = seen.withColumn("k", letter_mask("t"))
    # few terms make many pairs: blocks are cut in parts, and dealt out by number, as their bytes would not fill a task
    keys, tasks = ["group", "block", "part"], max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    a = seen.select("group", "block", F.col("t").alias("t1"), F.col("k").alias("k1"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part")).repartition(tasks, *keys)
    b = seen.select("group", "block", F.col("t").alias("t2"), F.col("k").alias("k2"), F.pmod(F.xxhash64("t"), F.lit(PARTS)).cast("int").alias("part")).repartition(tasks, *keys)
    pairs = a.join(b, keys).where("t1 < t2").drop("part")
    n, m = F.length("t1"), F.length("t2")
    pairs = pairs.where(1 - (F.least(n, m) / F.greatest(n, m) + 2) / 3 < jw)
    # a letter that the other has not matches nothing
    most = F.least(n - F.bit_count(F.expr("k1 & ~k2")), m - F.bit_count(F.expr("k2 & ~k1")))
    pairs = pairs.where(1 - (most / n + most / m + 1) / 3 < jw + 1e-9)
    if str2:
        pairs = pairs.where(F.right("t1", F.lit(str2)) == F.right("t2", F.lit(str2)))
    for p in [*(f"^{p}" for p in pref or []), *(f"{s}$" for s in suff or [])]:
        pairs = pairs.where(F.col("t1").rlike(p) == F.col("t2").rlike(p))
    close = pairs.where(1 - jaro_similarity()(F.col("t1"), F.col("t2")) < jw).select("t1", "t2", "group")
    scored = close.withColumn("m2", window_distance(alternative, q)(F.col("t1"), F.col("t2")))
    f1, f2 = freq.select(F.col("t").alias("t1"), F.col("f").alias("freq1")), freq.select(F.col("t").alias("t2"), F.col("f").alias("freq2"))
    return scored.join(f1, "t1").join(f2, "t2").select("group", "t1", "t2", "m2", "freq1", "freq2")


def replacements(synonyms: DataFrame, thresh: float) -> DataFrame:
    """(old, new): what clean_spell replaces: of each pair with m2 below thresh the rarer term by the commoner; equally common ones stay.

    A term with several commoner ones takes the commonest, of equal ones the first in the alphabet; chains lead to
    their end, each round of joins halving them. Repeated pairs count once; without a pair there are no rows.
    """
    first = F.col("freq1") < F.col("freq2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    pairs = synonyms.where((F.col("m2") < thresh) & (F.col("freq1") != F.col("freq2"))).select(pick("t1", "t2").alias("old"), pick("t2", "t1").alias("new"), pick("freq2", "freq1").alias("f"))
    to = written(pairs.groupBy("old").agg(F.min(F.struct(-F.col("f"), "new"))["new"].alias("new")), "replacements")
    while True:
        on = to.select(F.col("old").alias("new"), F.col("new").alias("end"))
        further = to.join(on, "new", "left")
        if further.where("end IS NOT NULL").isEmpty():
            return to
        last, to = to, written(further.select("old", F.coalesce("end", "new").alias("new")), "replacements")
        drop(last)


def replace_names(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """df with the names of a column replaced as (old, new) of replacements() says, by a join; all columns are kept."""
    old, new = fresh(df, "old", "new")
    joined = df.join(to.select(F.col("old").alias(old), F.col("new").alias(new)), F.col(column) == F.col(old), "left")
    return joined.withColumn(column, F.coalesce(new, column)).drop(old, new)
