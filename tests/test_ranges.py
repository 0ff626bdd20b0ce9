import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clastix.operators import ages, intervals

from .conftest import rows

TABLE = [("Examplidae", "Joebloggsia", 250.2, 247.1), ("Examplidae", "Joebloggsia", 250.2, 247.1), ("Taxonidae", "Facsimilus", 243.6, 241.1), (None, "Imperfectella", 243.6, 241.5), ("Taxonidae", "Automaton", 243.6, 241.5), ("Examplidae", None, 218.5, 210.8)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, "family string, genus string, max_ma double, min_ma double")


def test_age_ranges_max(table):
    assert rows(ages.age_ranges(table)) == [("Automaton", 243.6, 241.5, "genus"), ("Facsimilus", 243.6, 241.1, "genus"), ("Imperfectella", 243.6, 241.5, "genus"), ("Joebloggsia", 250.2, 247.1, "genus")]


def test_age_ranges_of_one_pair_are_turned_about_in_min(table):
    got = {r.taxon: (r.FAD, r.LAD) for r in ages.age_ranges(table, mode="min").collect()}
    assert got["Automaton"] == (241.5, 243.6)


def test_age_ranges_bounds(spark):
    x = spark.createDataFrame([("a", 10.0, 5.0), ("a", 8.0, 2.0), ("a", 8.0, 1.0)], "genus string, max_ma double, min_ma double")
    assert rows(ages.age_ranges(x, mode="bounds")) == [("a", 10.0, 8.0, 2.0, 1.0, "genus")]


def test_age_ranges_levels_and_checks(spark, table):
    assert ages.age_ranges(table, ["family", "genus"]).count() == 6
    with pytest.raises(ValueError, match="below"):
        ages.age_ranges(spark.createDataFrame([("a", 1.0, 2.0)], "genus string, max_ma double, min_ma double"))
    with pytest.raises(ValueError, match="no column"):
        ages.age_ranges(table, "order")


def test_chrono_scale(spark):
    scale = spark.createDataFrame([("Early", 100.0, 90.0), ("Late", 90.0, 80.0)], "Interval string, FAD double, LAD double")
    x = spark.createDataFrame([("Early", None, 1.0, 0.0), ("Late", "Early", 1.0, 0.0), ("Nowhere", None, 7.0, 6.0), ("Early", "Nowhere", 95.0, 91.0), (None, None, None, 3.0)], "e string, l string, a double, b double")
    got = [(r.newFAD, r.newLAD) for r in ages.chrono_scale(x, scale, "e", "l", "a", "b").collect()]
    assert got == [(100.0, 90.0), (90.0, 90.0), (7.0, 6.0), (100.0, 91.0), (None, None)]
    assert rows(ages.unmatched_intervals(x, scale, "e", "l")) == [("Nowhere",)]
    with pytest.raises(ValueError):
        ages.chrono_scale(x, scale, "e", "l", "a")
    with pytest.raises(ValueError):
        ages.check_scale(spark.createDataFrame([("x", 1.0, 2.0)], "Interval string, FAD double, LAD double"))


def test_add_kingdoms(spark):
    x = spark.createDataFrame([("1", "Mollusca"), ("2", "Pezizomycotina"), ("3", "Charophyta"), ("4", None), ("5", "Other"), ("6", "Both")], "id string, phylum string")
    k = {"Animalia": ["Mollusca", "Both"], "Plantae": ["Charophyta", "Both"]}
    out = ages.add_kingdoms(x, k)
    want = ["Animalia", "Fungi", "Plantae", None, None, "Plantae"]
    assert out.columns == ["id", "kingdom", "phylum"] and [r.kingdom for r in out.orderBy("id").collect()] == want
    t = spark.createDataFrame([(p, n) for n, ps in k.items() for p in ps], "phylum string, kingdom string")
    assert [r.kingdom for r in ages.add_kingdoms(x, t, insert_left=False).orderBy("id").collect()] == want
    with pytest.raises(ValueError):
        ages.add_kingdoms(out, k)


CODES = [((20, 10), "R1R"), ((21, 9), "0R0"), ((25, 21), "00R"), ((9, 5), "R00"), ((25, 15), "0R1"), ((15, 5), "1R0"), ((25, 20), "0R1"), ((10, 5), "1R0")]


def test_flag_codes(spark):
    x = spark.createDataFrame([("a", float(m), float(n)) for (m, n), _ in CODES] + [("b", 1.0, 0.0)], "genus string, max_ma double, min_ma double")
    y = spark.createDataFrame([("a", 20.0, 15.0), ("a", 12.0, 10.0)], "genus string, max_ma double, min_ma double")
    out = intervals.flag_ranges(x, y, ("genus", "max_ma", "min_ma"))
    got = {(r.genus, r.max_ma, r.min_ma): r for r in out.occurrence.collect()}
    for (m, n), code in CODES:
        assert got["a", m, n].status == code
    assert got["b", 1, 0].status == "000"
    assert (got["a", 25, 21].fad_diff, got["a", 25, 21].fad_flag_5, got["a", 9, 5].lad_diff, got["a", 9, 5].lad_flag_5) == (5.0, 1, 5.0, 1)
    t = {r.taxon: r for r in out.taxon.collect()}
    assert t["a"].status == "0R0" and (t["a"].n_1R1, t["a"].n_0R1, t["a"].n_1R0) == (1, 2, 2) and t["b"].status == "000"


def test_flag_status_compat(spark):
    x = spark.createDataFrame([("a", 25.0, 15.0), ("a", 15.0, 5.0)], "genus string, max_ma double, min_ma double")
    y = spark.createDataFrame([("a", 20.0, 10.0)], "genus string, max_ma double, min_ma double")
    cols = ("genus", "max_ma", "min_ma")
    assert intervals.flag_ranges(x, y, cols).taxon.first().status == "0R0"
    assert intervals.flag_ranges(x, y, cols, compat=True).taxon.first().status == "0R1"


def test_intersect_example(spark):
    x = spark.createDataFrame([(6.0, 1.5), (5.0, 3.0), (3.7, 2.1), (10.1, 1.0)], "max_ma double, min_ma double")
    assert rows(intervals.intersect_ranges(x)) == [(3.0, 3.7, 4)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=8))
def test_intersect_brute_force(spark, pairs):
    pairs = [(float(max(p)), float(min(p))) for p in pairs]
    depth = lambda v: sum(n <= v <= m for m, n in pairs)
    top = max(depth(v) for m, n in pairs for v in (m, n))
    got = rows(intervals.intersect_ranges(spark.createDataFrame(pairs, "max_ma double, min_ma double")))
    assert all(n == top and depth(a) == depth(b) == depth((a + b) / 2) == top for a, b, n in got)
    held = sum(1 for i in range(19) if depth(i / 2) == top)
    assert held == sum(1 for i in range(19) if any(a <= i / 2 <= b for a, b, _ in got))


def _revise(occ, ranges, prop):
    """The consensus of one assemblage by a loop: (revision, FAD, LAD)."""
    s0, e0 = occ[0][1:]
    foo = [ranges[t] for t in {o for o in occ} and sorted(set(occ)) for t in [t[0]] if t in ranges]
    if not foo:
        return "Unchecked", s0, e0
    points = {p for r in foo for p in r}
    share = {b: sum(low <= b <= high for high, low in foo) / len(foo) for b in points}
    top = max(share.values())
    if top < prop:
        return "Unresolved", s0, e0
    best = [b for b in points if share[b] == top]
    rf, rl = max(best), min(best)
    if rf >= s0 and rl <= e0:
        return "Retained", s0, e0
    if rf >= e0 and rl <= s0:
        return "Revised", min(rf, s0), max(rl, e0)
    return "Revised", rf, rl


@pytest.mark.parametrize("prop", [0.4, 0.75, 1.0])
def test_revise_against_loop(spark, prop):
    rng = random.Random(3)
    ranges = {f"t{i}": (float(a + rng.randint(0, 5)), float(a)) for i in range(6) for a in [rng.randint(0, 12)]}
    occ = []
    for a in range(25):
        for k in range(rng.randint(1, 5)):
            b = rng.randint(0, 14)
            occ.append((a, k, f"t{rng.randint(0, 7)}", float(b + rng.randint(0, 4)), float(b)))
    x = spark.createDataFrame(occ, "coll long, k long, genus string, max_ma double, min_ma double")
    y = spark.createDataFrame([(t, *r) for t, r in ranges.items()], "genus string, max_ma double, min_ma double")
    out = intervals.revise_ranges(x, y, ("genus", "max_ma", "min_ma"), "coll", ["k"], prop=prop)
    got = {r.assemblage: (r.revision, r.FAD, r.LAD) for r in out.collection.collect()}
    for a in range(25):
        own = [(o[2], o[3], o[4]) for o in occ if o[0] == a]
        assert got[a] == _revise(own, ranges, prop)
    assert out.occurrence.count() == len(occ)
    strict = intervals.revise_ranges(x, y, ("genus", "max_ma", "min_ma"), "coll", ["k"], prop=prop, allow_zero=False).collection
    assert all(r.FAD > r.LAD for r in strict.where("revision = 'Revised'").collect() if r.FAD != r.LAD)


def test_reproducible_across_partitions(spark, sf_dir):
    from clastix.plans.ranges import revise_ranges_collection

    seen = set()
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(rows(revise_ranges_collection(spark, sf_dir))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


CLASH = "genus string, max_ma double, min_ma double, status string, __t int, fad_diff int, FAD int, tax_flag int, col int, f int"


def test_results_leave_columns_of_the_same_names(spark):
    x = spark.createDataFrame([("a", 20.0, 5.0, "mine", 1, 2, 3, 4, 5, 6), ("b", 9.0, 8.0, "own", 1, 2, 3, 4, 5, 6), (None, 9.0, None, None, 1, 2, 3, 4, 5, 7)], CLASH)
    y = spark.createDataFrame([("a", 15.0, 6.0)], "genus string, max_ma double, min_ma double")
    cols = ("genus", "max_ma", "min_ma")
    out = intervals.flag_ranges(x, y, cols).occurrence
    assert out.columns[: len(x.columns)] == x.columns and rows(out.select(*x.columns)) == rows(x)
    assert {r.f: (r.status_, r.fad_diff_) for r in out.where("genus = 'a'").collect()} == {6: ("0R0", 5.0)}
    got = intervals.revise_ranges(x, y, cols, "col", ["max_ma"]).occurrence
    assert got.columns[: len(x.columns)] == x.columns and rows(got.select(*x.columns)) == rows(x) and {"FAD_", "tax_flag_", "LAD"} <= set(got.columns)
    hit = intervals.intersect_ranges(x.withColumnsRenamed({"f": "v", "col": "o", "FAD": "d"}), by=["v"])
    assert rows(hit) == [(6, 8.0, 9.0, 2)]


def test_intersections_of_a_whole_table_in_parts(spark):
    import random

    rng = random.Random(4)
    data = [(a := rng.randint(0, 400) / 4, a + rng.randint(0, 80) / 4) for _ in range(3000)] + [(7.0, None)]
    df = spark.createDataFrame([(b, a) for a, b in data], "max_ma double, min_ma double").repartition(7)
    whole = data[:-1]
    ends = sorted({x for p in whole for x in p})
    n = {x: sum(a <= x <= b for a, b in whole) for x in ends}
    top = max(n.values())
    got = rows(intervals.intersect_ranges(df))
    assert [(r[0], r[2]) for r in got] == sorted([(x, top) for x in {a for a, _ in whole} if n[x] == top], key=str)
    assert all(r[1] >= r[0] and not any(r[0] < a < r[1] for a, _ in whole) for r in got)
    assert intervals.intersect_ranges(df.limit(0)).isEmpty()


def test_dating_and_slicing_leave_columns_of_the_same_names(spark):
    from clastix.operators import ages, peaks

    x = spark.createDataFrame([("Early", None, 1, 2, 3), ("Nowhere", "Late", 4, 5, 6), (None, None, 7, 8, 9)], "early_interval string, late_interval string, newFAD int, i int, x int")
    scale = spark.createDataFrame([("Early", 30.0, 20.0), ("Late", 20.0, 10.0), ("Early", 30.0, 20.0)], "Interval string, FAD double, LAD double")
    out = ages.chrono_scale(x, scale)
    assert rows(out.select(*x.columns)) == rows(x) and {r.x: (r.newFAD_, r.newLAD) for r in out.collect()} == {3: (30.0, 20.0), 6: (None, None), 9: (None, None)}
    assert ages.chrono_scale(x.limit(0), scale).isEmpty()
    y = spark.createDataFrame([("a", 50.0, 48.0, "s", 1)] * 5 + [("a", 12.0, 10.0, "s", 2)] * 5, "genus string, max_ma double, min_ma double, split string, cuts int")
    got = peaks.threshold_ranges(y, thresh=5).data
    assert {(r.cuts, r.split, r.split_) for r in got.collect()} == {(1, "s", "a_2/2"), (2, "s", "a_1/2")}
    kingdoms = spark.createDataFrame([("P", "Plantae")], "phylum string, kingdom string")
    assert rows(ages.add_kingdoms(spark.createDataFrame([("P", 1), (None, 2)], "phylum string, name int"), kingdoms)) == [("Plantae", "P", 1), (None, None, 2)]


def _nodes(plan):
    """The nodes of a physical plan, with what runs inside adaptive ones."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = plan.children()
    parts = [_nodes(p) for p in inner + [below.apply(i) for i in range(below.size())]]
    return [(kind, plan, parts)] + [n for p in parts for n in p]


def _plan(df):
    return _nodes(df._jdf.queryExecution().executedPlan())


def _shuffles(plan):
    return [p for kind, p, _ in plan if kind == "ShuffleExchangeExec"]


def _revised(spark, n=200, **more):
    """(occurrences, ranges, result): with repeated rows, gaps, an assemblage of many rows and ranges the wrong way round."""
    rng = random.Random(n)
    ranges = [(f"t{i}", float(a + rng.randint(-1, 5)), float(a)) for i in range(9) for a in [rng.randint(0, 12)]]
    occ = []
    for k in range(n):
        b = rng.randint(0, 14)
        a = rng.choice([None, 0, 0, *range(1, 40)])
        ages = rng.choice([(float(b + rng.randint(0, 4)), float(b))] * 5 + [(None, float(b))] if k % 3 else [(float(b), float(b))])
        occ += [(a, k, rng.choice([None, *(f"t{i}" for i in range(11))]), *ages)] * rng.choice([1, 1, 2])
    x = spark.createDataFrame(occ, "coll long, k long, genus string, max_ma double, min_ma double")
    y = spark.createDataFrame(ranges, "genus string, max_ma double, min_ma double")
    return occ, {t: (f, l) for t, f, l in ranges}, intervals.revise_ranges(x, y, ("genus", "max_ma", "min_ma"), "coll", ["k"], **more)


def _code(m, n, f, l):  # noqa: E741
    if m is None or n is None:
        return "000"
    if m <= f and n >= l:
        return "R1R"
    if n < l and m > f:
        return "0R0"
    if m > f and n > f:
        return "00R"
    if n < l and m < l:
        return "R00"
    return "0R1" if l <= n <= f and m > f else "1R0"


@pytest.mark.parametrize("prop", [0.3, 0.6, 1.0])
@pytest.mark.parametrize("do_flag", [False, True])
def test_revise_rows_and_status_against_loop(spark, prop, do_flag):
    occ, ranges, out = _revised(spark, prop=prop, do_flag=do_flag)
    got = {r.assemblage: r for r in out.collection.collect()}
    want, flags = {}, {}
    for a in {o[0] for o in occ} - {None}:
        own = [o for o in occ if o[0] == a]
        _, _, _, s0, e0 = min(own, key=lambda o: o[1])
        foo = [ranges[t] for t, m, n in {o[2:] for o in own} if t in ranges and m is not None and n is not None]
        work = not do_flag or any(_code(m, n, *ranges[t]) not in ("000", "R1R") for _, _, t, m, n in own if t in ranges)
        share = {b: sum(low <= b <= high for high, low in foo) / len(foo) for r in foo for b in r}
        top = max(share.values(), default=None)
        best = [b for b in share if share[b] == top]
        revision, nf, nl, p = "Unchecked", s0, e0, None
        if work and foo:
            rf, rl, ok = max(best), min(best), s0 is not None
            revision = "Unresolved" if top < prop else "Retained" if ok and rf >= s0 and rl <= e0 else "Revised"
            if revision == "Retained":
                p = 1.0
            elif revision == "Revised":
                nf, nl, p = (min(rf, s0), max(rl, e0), top) if ok and rf >= e0 and rl <= s0 else (rf, rl, top)
        changed = p is not None
        for t, (f, l) in ranges.items():  # noqa: E741
            after, before = changed and p < 1 and f <= nl and l < nl, changed and p < 1 and f > nf and l >= nf
            flags[a, t] = "R00" if after else "00R" if before else "R1R" if changed and p == 1 else "000"
        mine = {flags[a, o[2]] for o in own if o[2] in ranges}
        status = "000" if not changed else "R1R" if p == 1 else "0R0" if {"R00", "00R"} <= mine else "00R" if "00R" in mine else "R00" if "R00" in mine else "000"
        want[a] = (revision, nf, nl, p, status)
        flags[a, None] = "R1R" if changed and p == 1 else "000"
    assert {a: (r.revision, r.FAD, r.LAD, r.prop, r.status) for a, r in got.items()} == want
    rows_of = out.occurrence.collect()
    assert sorted(str(tuple(r)[:5]) for r in rows_of) == sorted(str(o) for o in occ)
    for r in rows_of:
        if r.coll is None:
            assert (r.FAD, r.LAD, r.tax_flag) == (r.max_ma, r.min_ma, "000")
            continue
        revision, nf, nl, _, _ = want[r.coll]
        kept = revision not in ("Revised", "Retained")
        assert (r.FAD, r.LAD) == ((r.max_ma, r.min_ma) if kept else (nf, nl))
        assert r.tax_flag == flags[r.coll, r.genus if r.genus in ranges else None]


def test_revised_rows_are_shuffled_once_a_column(spark):
    """Rows go to their taxon's range and to their assemblage, and every other shuffle is narrower; none carries a column twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _shuffles(_plan(_revised(spark, prop=0.5, do_flag=True)[2].occurrence))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = sum(p.output().size() for p in found)
    assert len(found) <= 8 and wide <= 36, (len(found), wide)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([0.0, 1e-20, 0.05, 0.1, 1.0, 1.1, 2.0, 3.0]), st.sampled_from([0.0, 0.1, 1.0, 1.1, 2.0, 2.5])), min_size=1, max_size=6))
def test_bounds_against_all_endpoints(spark, data):
    """Rows the wrong way round, and ages that SHIFT makes equal, too."""
    want = {}
    for taxon in {t for t, _, _ in data}:
        ends = {(m + ages.SHIFT, 1, m) for t, m, _ in data if t == taxon} | {(n, 0, n) for t, _, n in data if t == taxon}
        age = [a for _, _, a in sorted(ends, reverse=True)]
        want[taxon] = (age[0], age[1], age[-2], age[-1])
    x = spark.createDataFrame(data, "genus string, max_ma double, min_ma double")
    got = {r.taxon: (r.FAD_early, r.FAD_late, r.LAD_early, r.LAD_late) for r in ages.age_ranges(x, mode="bounds", validate=False).collect()}
    assert got == want


@pytest.mark.parametrize("mode", ["bounds", "min"])
def test_bounds_sort_one_endpoint_of_a_row(spark, mode):
    rng = random.Random(5)
    data = [(f"t{rng.randint(0, 9)}", float(a + rng.randint(0, 9)), float(a)) for a in (rng.randint(0, 99) for _ in range(2000))]
    df = ages.age_ranges(spark.createDataFrame(data, "genus string, max_ma double, min_ma double"), mode=mode)
    df.collect()
    made = [p.metrics().apply("numOutputRows").value() for kind, p, _ in _plan(df) if kind == "GenerateExec"]
    assert len(made) >= 2 and sum(made) <= 2 * 2000 + 2 * 10 + 2 * 10


@pytest.mark.parametrize("err", [None, "e"])
def test_first_rows_are_not_sorted_in_the_scan(spark, err):
    """What a task sorts is then bounded by a shuffled partition, not by a part of a file."""
    x = spark.createDataFrame([(1, 1, "a", 5.0, 4.0, "0R1"), (1, 2, "b", 9.0, 1.0, "000"), (2, 1, "a", 3.0, 2.0, "000")], "coll long, k long, genus string, max_ma double, min_ma double, e string")
    out = intervals.revise_ranges(x, x.where("k = 1").select("genus", "max_ma", "min_ma"), ("genus", "max_ma", "min_ma"), "coll", ["k", "genus"], err=err).collection
    sorts = [[n[0] for part in below for n in part] for kind, _, below in _plan(out) if kind == "SortExec"]
    assert sorts and all("ShuffleExchangeExec" in below for below in sorts)
    got = {r.assemblage: (r.revision, r.FAD, r.LAD, r.prop) for r in out.collect()}
    assert got == {1: ("Retained", 5.0, 4.0, 1.0), 2: ("Unchecked", 3.0, 2.0, None) if err else ("Retained", 3.0, 2.0, 1.0)}


def test_a_collection_takes_one_join_with_ranges_and_one_with_first_rows(spark):
    plan = _plan(_revised(spark, do_flag=True)[2].collection)
    assert sum("Join" in kind for kind, *_ in plan) == 2
