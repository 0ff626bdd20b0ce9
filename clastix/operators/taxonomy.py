"""The whole check of a classification: formatting, spelling, ranks, conflicts, and their repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TaxonomyResult, require, require_text
from . import names, ranks as hierarchy

ROUTINE = tuple("format_check spell_check discrete_ranks find_duplicates".split())
_SYNONYMS = "level string, `group` string, t1 string, t2 string, m2 double, freq1 bigint, freq2 bigint"


def check_taxonomy(
    df: DataFrame,
    ranks: list[str],
    row_id: str,
    species: bool = False,
    species_sep: str = " ",
    routine: tuple[str, ...] = ROUTINE,
    clean_name: bool = False,
    clean_spell: bool = False,
    thresh: float | dict[str, float] = 0.05,
    resolve_duplicates: bool = False,
    append: bool = True,
    terms: dict[str, list[str]] | None = None,
    collapse: dict[str, list[str]] | None = None,
    jw: float = 0.1,
    str_: int | None = 1,
    str2: int | None = None,
    alternative: str = "jaccard",
    q: int = 1,
    pref: dict[str, list[str]] | None = None,
    suff: dict[str, list[str]] | None = None,
    exclude: dict[str, list[str]] | None = None,
    jump: int = 3,
) -> TaxonomyResult:
    """The steps of routine, in the order of ROUTINE, over the rank columns (the highest first), with repairs on request.

    clean_name cleans all names first; clean_spell replaces the rarer of two similar names with m2 below
    thresh (one value or one by rank); resolve_duplicates makes the classification a tree, letters
    telling retained alternatives apart unless append is false. What each step reports is as of then.
    Per-rank options are by rank. A step left out reports nothing.
    """
    require_text(df, *ranks)
    require(df, row_id)
    if unknown := set(routine) - set(ROUTINE):
        raise ValueError(f"routine has unknown steps {sorted(unknown)}")
    at = lambda options, r: (options or {}).get(r)
    spark = df.sparkSession
    x = df
    formatting = spark.createDataFrame([], f"check string, rank string, row_id {df.schema[row_id].dataType.simpleString()}")
    if "format_check" in routine:
        formatting = names.format_check(df, ranks, row_id, species, species_sep)
    if clean_name:
        x = names.clean_names(x, ranks, terms, collapse)
    synonyms = spark.createDataFrame([], _SYNONYMS)
    if "spell_check" in routine:
        found = [names.spell_check(x, low, high, jw, str_, str2, alternative, q, at(pref, low), at(suff, low), at(exclude, low)).select(F.lit(low).alias("level"), "*") for high, low in zip(ranks, ranks[1:])]
        synonyms = reduce(DataFrame.unionByName, found)
        if clean_spell:
            for low in ranks[1:]:
                limit = thresh if isinstance(thresh, (int, float)) else thresh.get(low, 0.0)
                x = names.replace_names(x, low, names.replacements(synonyms.where(F.col("level") == low), limit))
    crossed = spark.createDataFrame([], "scope string, rank string, other_rank string, name string")
    if "discrete_ranks" in routine:
        crossed = hierarchy.discrete_ranks(x, list(reversed(ranks)))
    duplicates = spark.createDataFrame([], "taxon string, rank string")
    if "find_duplicates" in routine:
        duplicates = hierarchy.find_duplicates(x, ranks)
    if resolve_duplicates:
        x = x.withColumns({r: F.concat(F.lit(str(k)), F.regexp_replace(r, "[0-9]", "")) for k, r in enumerate(ranks)})
        x = hierarchy.resolve_duplicates(x, ranks, jump)
        x = x.withColumns({r: F.regexp_replace(r, "[0-9]", "") for r in ranks})
    if not append and (clean_name or clean_spell or resolve_duplicates):
        x = x.withColumns({r: F.regexp_replace(r, "[A-Z]$", "") for r in ranks})
    return TaxonomyResult(x, formatting, synonyms, crossed, duplicates)
