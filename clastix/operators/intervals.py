"""Occurrences against reference ranges, overlaps of intervals, and consensus ages of assemblages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FlagResult, RevisionResult, assert_ranges, require, require_number
from ..shared import fresh, written
from .ages import age_ranges

CODES = ("000", "R1R", "0R1", "1R0", "0R0", "00R", "R00")
COUNTED = ("1R1", "0R1", "1R0", "0R0", "00R", "R00")


def range_code(m: Column, n: Column, f: Column, l: Column) -> Column:  # noqa: E741
    """The code of an occurrence from m (old) to n (young) against the range from f to l; 000 without a range.

    R1R lies within, 0R0 beyond both ends, 00R wholly before it, R00 wholly after it, 0R1 and 1R0 across its old or young end.
    """
    return (
        F.when(f.isNull() | l.isNull() | m.isNull() | n.isNull(), "000")
        .when((m <= f) & (n >= l), "R1R")
        .when((n < l) & (m > f), "0R0")
        .when((m > f) & (n > f), "00R")
        .when((n < l) & (m < l), "R00")
        .when((n >= l) & (n <= f) & (m > f), "0R1")
        .otherwise("1R0")
    )


def _status(compat: bool) -> Column:
    n = {k: F.col(f"n_{k}") > 0 for k in COUNTED}
    a, b, c, d = n["00R"], n["R00"], n["0R1"], n["1R0"]
    return (
        F.when(n["0R0"], "0R0")
        .when(a & b, "0R0")
        .when(a & d, "0R0")
        .when(a, "00R")
        .when(b & c, "0R0")
        .when(b, "R00")
        .when(c & d, "0R1" if compat else "0R0")
        .when(c, "0R1")
        .when(d, "1R0")
        .otherwise("R1R")
    )


def reference_ranges(y: DataFrame, ycols: tuple[str, str, str]) -> DataFrame:
    """(taxon, f, l): the widest range of each taxon of y."""
    taxon, srt, end = ycols
    return age_ranges(y, taxon, srt, end, "max", validate=False).select(F.col("taxon").alias("__t"), F.col("FAD").alias("__f"), F.col("LAD").alias("__l"))


def flag_occurrences(x: DataFrame, ranges: DataFrame, xcols: tuple[str, str, str], flag_diff: list[float], compat: bool = False) -> DataFrame:
    """x with status, fad_diff, lad_diff and a pair of flags for each threshold. x may be a stream.

    All columns of x stay; a result whose name x has already gets underscores behind it.
    """
    taxon, srt, end = xcols
    t, f, l = fresh(x, "t", "f", "l")  # noqa: E741
    out = x.join(ranges.toDF(t, f, l), F.col(taxon).cast("string") == F.col(t), "left")
    m, n, f, l = (F.col(c).cast("double") for c in (srt, end, f, l))  # noqa: E741
    code = range_code(m, n, f, l)
    fad = F.when(code.isin("0R0", "00R", "0R1"), m - f)
    lad = F.when(code.isin("0R0", "R00", "1R0"), (f if compat else l) - n)
    made = {"status": code, "fad_diff": F.round(fad, 2), "lad_diff": F.round(lad, 2)}
    for d in flag_diff:
        name = f"{d:g}".replace(".", "_")
        made[f"fad_flag_{name}"] = F.coalesce((fad >= float(d)).cast("int"), F.lit(0))
        made[f"lad_flag_{name}"] = F.coalesce((lad >= float(d)).cast("int"), F.lit(0))
    return out.select(*[x[c] for c in x.columns], *[v.alias(k) for k, v in zip(fresh(x, *made), made.values())])


def flag_ranges(x: DataFrame, y: DataFrame, xcols: tuple[str, str, str], ycols: tuple[str, str, str] | None = None, flag_diff: float | list[float] = 5, compat: bool = False) -> FlagResult:
    """Occurrences x against the ranges of y: a code for each occurrence, and a summary of each taxon.

    xcols and ycols: taxon, start and end. y may have several rows per taxon; their widest range counts.
    Differences are to two places, flags are of the exact ones. A taxon without a range has status 000 in
    the summary too. compat keeps two known slips of the original: lad_diff measured from the FAD, and
    0R1 for taxa that cross both ends in different occurrences. An occurrence without a taxon or an age is 000 and
    counts in no summary; repeated rows are flagged each; an empty x gives empty results. Columns of x stay, see
    flag_occurrences().
    """
    require(x, *xcols)
    require(y, *(ycols or xcols))
    diffs = [flag_diff] if isinstance(flag_diff, (int, float)) else list(flag_diff)
    ranges = reference_ranges(y, ycols or xcols)
    occurrence = flag_occurrences(x, ranges, xcols, diffs, compat)
    taxon, srt, end = (F.col(c) for c in xcols)
    seen = x.where(taxon.isNotNull()).select(taxon.cast("string").alias("taxon"), srt.cast("double").alias("m"), end.cast("double").alias("n"))
    # ranges by taxon first: occurrences are summed to one row per taxon and age before they meet the other table
    rows = seen.groupBy("taxon", "m", "n").count().join(ranges, F.col("taxon") == F.col("__t"), "left").withColumn("code", F.when(F.col("__t").isNull(), "000").otherwise(range_code(F.col("m"), F.col("n"), F.col("__f"), F.col("__l"))))
    counts = [F.sum(F.when(F.col("code") == ("R1R" if k == "1R1" else k), F.col("count")).otherwise(0)).cast("long").alias(f"n_{k}") for k in COUNTED]
    t = rows.groupBy("taxon").agg(*counts, F.max("m").alias("m"), F.min("n").alias("n"), F.max("__f").alias("f"), F.max("__l").alias("l"))
    over, under = F.col("m") - F.col("f"), F.col("l") - F.col("n")
    summary = t.select(
        "taxon",
        F.when(F.col("f").isNull(), "000").otherwise(_status(compat)).alias("status"),
        *[f"n_{k}" for k in COUNTED],
        F.round(F.when(over > 0, over), 2).alias("fad_diff"),
        F.round(F.when(under > 0, under), 2).alias("lad_diff"),
    )
    return FlagResult(summary, occurrence)


def intersect_ranges(df: DataFrame, srt: str = "max_ma", end: str = "min_ma", by: list[str] | None = None, validate: bool = False) -> DataFrame:
    """(by, lb, ub, N): where most closed intervals of each group overlap, every such stretch, and how many do.

    A sweep over endpoints: +1 where an interval starts, -1 after it ends. Without by all rows are one group, whose
    endpoints are swept in parts: sorted over all tasks, summed part by part, each part beginning at the sum of those before.
    Rows without an age don't count; an empty table gives no rows.
    """
    require_number(df, srt, end)
    if validate:
        assert_ranges(df, srt, end)
    keys = list(by or [])
    v, o, d = fresh(df, "v", "o", "d")
    lo, hi = F.col(end).cast("double"), F.col(srt).cast("double")
    points = (
        df.where(lo.isNotNull() & hi.isNotNull())
        .select(*keys, F.inline(F.array(F.struct(lo.alias(v), F.lit(0).alias(o), F.lit(1).alias(d)), F.struct(hi.alias(v), F.lit(1).alias(o), F.lit(-1).alias(d)))))
        .groupBy(*keys, v, o)
        .agg(F.sum(d).alias(d))
    )
    if keys:
        order = Window.partitionBy(*keys).orderBy(v, o)
        swept = points.withColumns({"N": F.sum(d).over(order), "ub": F.lead(v).over(order)}).withColumn("top", F.max("N").over(Window.partitionBy(*keys)))
    else:
        parts = written(points.repartitionByRange(v, o).withColumn("p", F.spark_partition_id()), "endpoints")
        along = Window.orderBy("p")  # over one row for each part
        each = parts.groupBy("p").agg(F.sum(d).alias("s"), F.min(v).alias("first")).select("p", (F.sum("s").over(along) - F.col("s")).alias("so_far"), F.lead("first").over(along).alias("next"))
        order = Window.partitionBy("p").orderBy(v, o)
        swept = parts.join(F.broadcast(each), "p").withColumns({"N": F.sum(d).over(order) + F.col("so_far"), "ub": F.coalesce(F.lead(v).over(order), "next")})
        swept = swept.join(F.broadcast(swept.agg(F.max("N").alias("top"))), F.col("N") == F.col("top"))  # one row
    return swept.where((F.col(o) == 0) & (F.col("N") == F.col("top"))).select(*keys, F.col(v).alias("lb"), "ub", F.col("N").cast("long").alias("N"))


def revise_ranges(
    x: DataFrame,
    y: DataFrame,
    xcols: tuple[str, str, str],
    assemblage: str,
    order_by: list[str],
    ycols: tuple[str, str, str] | None = None,
    err: str | None = None,
    do_flag: bool = False,
    prop: float = 0.75,
    allow_zero: bool = True,
) -> RevisionResult:
    """Consensus ages of assemblages (rows of one value of assemblage) from the reference ranges of their taxa.

    An assemblage is revised if an occurrence in it has an error code: of column err, by flag_ranges() with
    do_flag, else every one. Its candidate ages are the endpoints of its taxa's ranges; the solution is the
    stretch between those that most ranges hold, if at least the share prop does. Retained: it covers
    the original age (that of the first row by order_by). Revised: the overlap of both or, if there is
    none, the solution. Without allow_zero the solution is the pair of distinct candidates of the highest
    mean share. Occurrences of a revised assemblage take its age; taxa whose range lies wholly before
    or after it are 00R or R00; if all ranges agree, all are R1R. The rows of the result are in no order. Rows without
    an assemblage are revised with none, those without a taxon or age take their assemblage's age; repeated rows are
    all kept. Columns of x stay; a result whose name x has already gets underscores behind it.
    """
    taxon, srt, end = xcols
    require(x, taxon, srt, end, assemblage, *order_by)
    ranges = reference_ranges(y, ycols or xcols)
    key, name, s, e = F.col(assemblage), F.col(taxon).cast("string"), F.col(srt).cast("double"), F.col(end).cast("double")
    wrong = lambda code: F.coalesce(~code.isin("000", "R1R"), F.lit(False))
    # rows meet those of their assemblage before the first is taken: to take it in the scan would sort all of a task's rows there
    at = {c: f"__{i}" for i, c in enumerate(dict.fromkeys([*order_by, srt, end]))}
    rows = x.where(key.isNotNull()).select(key.alias("__a"), *[F.col(c).alias(v) for c, v in at.items()], (wrong(F.col(err)) if err else F.lit(not do_flag)).alias("w")).repartition("__a")
    first = F.min(F.struct(*[at[c] for c in order_by], F.col(at[srt]).cast("double").alias("s"), F.col(at[end]).cast("double").alias("e")))
    info = rows.groupBy("__a").agg(first.alias("first"), F.bool_or("w").alias("w")).select("__a", F.col("first.s").alias("s0"), F.col("first.e").alias("e0"), "w")
    taxa = x.where(key.isNotNull()).select(key.alias("__a"), name.alias("__x"), s.alias("__s"), e.alias("__e")).join(ranges, F.col("__x") == F.col("__t")).drop("__t").repartition("__a")
    foo = taxa.withColumn("r", F.row_number().over(Window.partitionBy("__a", "__x", "__s", "__e").orderBy("__s"))).where("r = 1")
    # how many ranges of an assemblage hold each endpoint: starts so far less ends so far, by a sweep; k: of which ranges it is an endpoint
    f, l, zero = F.col("__f"), F.col("__l"), F.lit(0)  # noqa: E741
    aged = (F.col("__s").isNotNull() & F.col("__e").isNotNull()).cast("int")
    flagged = F.when(wrong(range_code(F.col("__s"), F.col("__e"), f, l)), 16).otherwise(0) if do_flag and not err else zero
    kind = lambda forward, backward: (F.when(l < f, forward).otherwise(backward) + flagged).alias("k")
    points = foo.select("__a", F.inline(F.array(F.struct(l.alias("b"), aged.alias("i"), zero.alias("o"), kind(4, 2)), F.struct(f.alias("b"), zero.alias("i"), aged.alias("o"), kind(1, 8)))))
    whole = Window.partitionBy("__a")
    upto, here = whole.orderBy("b"), whole.orderBy("b").rangeBetween(Window.currentRow, Window.currentRow)
    n = points.withColumn("N", F.sum("i").over(upto) - F.sum("o").over(upto) + F.sum("o").over(here)).withColumn("p", F.when(F.col("i") + F.col("o") > 0, F.col("N") / F.sum("i").over(whole)))
    of = lambda bit: F.when(F.col("k").bitwiseAND(bit) > 0, F.col("b"))
    known = F.col("p").isNotNull()
    # the greatest of structs: an aggregate along the sweep's order, without a hash table
    each = [F.max(F.when(known, F.struct("p", "b"))).alias("hi"), F.max(F.when(known, F.struct("p", (-F.col("b")).alias("b")))).alias("lo"), F.bool_or(F.col("k") >= 16).alias("flagged")]
    each += [F.min(of(1)).alias("f_min"), F.min(of(2)).alias("l_min"), F.max(of(4)).alias("l_max"), F.max(of(8)).alias("f_max")]
    if allow_zero:
        solution = n.groupBy(F.col("__a").alias("__k")).agg(*each).withColumns({"rf": F.col("hi.b"), "rl": -F.col("lo.b"), "m": F.col("hi.p"), "top": F.col("hi.p")})
    else:
        rank = F.dense_rank().over(whole.orderBy(F.desc("p"), F.desc("b")))
        two = n.withColumn("r", rank).withColumn("two", (F.col("p") >= prop) & (F.col("r") <= 2))
        b, p = F.when(F.col("two"), F.col("b")), F.when(F.col("two"), F.col("p"))
        each += [F.max(b).alias("rf"), F.min(b).alias("rl"), ((F.max(p) + F.min(p)) / 2).alias("mean"), F.max(F.when(F.col("two"), F.col("r"))).alias("c")]
        solution = two.groupBy(F.col("__a").alias("__k")).agg(*each).withColumns({"top": F.col("hi.p"), "m": F.coalesce("mean", "hi.p")})
    paired = F.lit(True) if allow_zero else F.coalesce(F.col("c"), F.lit(0)) == 2
    got = info.join(solution, F.col("__a") == F.col("__k"), "left")
    covers = (F.col("rf") >= F.col("s0")) & (F.col("rl") <= F.col("e0"))
    meets = (F.col("rf") >= F.col("e0")) & (F.col("rl") <= F.col("s0")) if allow_zero else (F.col("rf") > F.col("e0")) & (F.col("rl") < F.col("s0"))
    work = F.col("w") | F.coalesce(F.col("flagged"), F.lit(False))
    revision = F.when(~work | F.col("m").isNull(), "Unchecked").when((F.col("top") < prop) | ~paired, "Unresolved").when(covers, "Retained").otherwise("Revised")
    got = got.withColumn("revision", revision)
    new = F.col("revision") == "Revised"
    got = got.withColumns(
        {
            "FAD": F.when(new & meets, F.least("rf", "s0")).when(new, F.col("rf")).otherwise(F.col("s0")),
            "LAD": F.when(new & meets, F.greatest("rl", "e0")).when(new, F.col("rl")).otherwise(F.col("e0")),
            "prop": F.when(F.col("revision") == "Retained", F.lit(1.0)).when(new, F.col("m")),
        }
    )
    # a range lies after the new age if f <= LAD and l < LAD: of those with l < f the least f tells, of others the least l
    partial = new & (F.col("prop") < 1)
    r = F.coalesce(partial & ((F.col("f_min") <= F.col("LAD")) | (F.col("l_min") < F.col("LAD"))), F.lit(False))
    o = F.coalesce(partial & ((F.col("l_max") >= F.col("FAD")) | (F.col("f_max") > F.col("FAD"))), F.lit(False))
    settled = F.col("revision").isin("Revised", "Retained")
    status = F.when(~settled, "000").when(F.col("prop") == 1, "R1R").when(o & r, "0R0").when(o, "00R").when(r, "R00").otherwise("000")
    collection = got.select(F.col("__a").alias("assemblage"), "FAD", "LAD", "revision", status.alias("status"), "prop")
    # once a name: what the columns of x hold already isn't shuffled beside them
    made = fresh(x, "tax_flag", "FAD", "LAD", "FAD_diff", "LAD_diff", "__t", "__f", "__l", "__k", "__nf", "__nl", "__r", "__p")
    t, f, l, k, nf, nl, rev, p = made[5:]  # noqa: E741
    solved = got.select(F.col("__a").alias(k), F.col("FAD").alias(nf), F.col("LAD").alias(nl), F.col("revision").alias(rev), F.col("prop").alias(p))
    occ = x.join(ranges.toDF(t, f, l), name == F.col(t), "left").drop(t).join(solved, key == F.col(k), "left")
    changed = F.coalesce(F.col(rev).isin("Revised", "Retained"), F.lit(False))
    partial = changed & (F.col(p) < 1)
    after = F.coalesce(partial & (F.col(f) <= F.col(nl)) & (F.col(l) < F.col(nl)), F.lit(False))
    before = F.coalesce(partial & (F.col(f) > F.col(nf)) & (F.col(l) >= F.col(nf)), F.lit(False))
    flag = F.when(after, "R00").when(before, "00R").when(changed & (F.col(p) == 1), "R1R").otherwise("000")
    fad, lad = F.when(changed, F.col(nf)).otherwise(s), F.when(changed, F.col(nl)).otherwise(e)
    values = flag, fad, lad, F.when(flag == "00R", F.abs(fad - s)), F.when(flag == "R00", F.abs(lad - e))
    return RevisionResult(collection, occ.withColumns(dict(zip(made, values))).drop(*made[6:]))
