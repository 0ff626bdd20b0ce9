import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clastix.operators import density, peaks

from .conftest import rows


@pytest.fixture(scope="module")
def occ(spark):
    return spark.createDataFrame([("a", 10.0, 8.0), ("a", 10.0, 8.0), ("a", 4.0, 2.5), ("b", 5.0, 5.0), (None, 3.0, 1.0)], "genus string, max_ma double, min_ma double")


def samples(s, e, d=0.1):
    return [max(s + d - k * d, e) for k in range(int(math.floor((s + d - e) / d + 1e-10)) + 1)]


def test_points_and_histogram(occ):
    pts = {(r.taxon, round(r.p, 9)): r.w for r in density.points(occ, "genus", "max_ma", "min_ma", 0.1).collect()}
    want = samples(10, 8) * 2 + samples(4, 2.5)
    assert sum(w for (t, _), w in pts.items() if t == "a") == len(want)
    h = {(r.taxon, r.t): r.hist for r in density.densify(occ, method="histogram").collect()}
    assert h["a", 9.0] == math.ceil(sum(8 + 1e-7 < p <= 9 + 1e-7 for p in want) / 10) and ("a", 6.0) not in h and ("b", 6.0) in h


def test_kernel_is_the_exact_sum(occ):
    pts = np.array(samples(10, 8) * 2 + samples(4, 2.5))
    q3, q1 = np.quantile(pts, [0.75, 0.25])
    bw = 0.9 * min(pts.std(ddof=1), (q3 - q1) / 1.34) * len(pts) ** -0.2
    lo, hi = math.floor(pts.min()), math.ceil(pts.max())
    n = hi - lo
    for r in density.densify(occ).where("taxon = 'a'").collect():
        x = lo + (r.t - 1 - lo) * (hi - lo) / (n - 1)
        assert r.kdensity == pytest.approx(np.exp(-0.5 * ((x - pts) / bw) ** 2).sum() / (len(pts) * bw * math.sqrt(2 * math.pi)), rel=1e-9)


def test_dense_and_profile(occ):
    d = density.densify(occ, method="histogram")
    assert [r.hist for r in density.density_profile(d, "a").orderBy("t").collect() if r.t == 6.0] == [0]
    assert density.dense(d, common=True).count() == 2 * (11 - 3 + 1)


def test_quantiles(spark):
    g = spark.createDataFrame([("a", float(x), 1.0) for x in range(11)], "taxon string, x double, y double")
    r = density.quantiles(g, [0.5, 0.0]).first()
    assert 4.0 < r.q0 < 6.0 and r.q1 == float("-inf")


def test_pacmacro(spark):
    x = spark.createDataFrame([("a", 50.0, 50.0)] + [("a", 20.0 + k % 3, 18.0) for k in range(200)] + [("c", 9.0, 9.0)], "genus string, max_ma double, min_ma double")
    got = {r.taxon: r for r in density.pacmacro_ranges(x).collect()}
    assert got["a"].FAD == 50 and got["a"].FAD95 < 24 and got["a"].tflag0_35 == 1 and got["c"].tflag0_35 is None
    k = {r.taxon: r for r in density.pacmacro_ranges(x, method="kernel").collect()}
    assert k["a"].FAD95 < 30 and k["a"].LAD <= k["a"].LAD95
    with pytest.raises(ValueError):
        density.pacmacro_ranges(x, method="other")


def test_smooth_keeps_lines_and_means():
    v = np.arange(11) * 2.0 + 1
    assert np.allclose(peaks.smoother(11) @ v, v)
    assert (peaks.smoother(11) @ np.array([0, 0, 0, 0, 0, 5.0, 0, 0, 0, 0, 0]))[5] == pytest.approx(1.0)


def peaks_of(t, v, win):
    """Peaks and troughs of one profile, from old to young, place by place."""
    keep = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1]]
    u = [0, *(v[i] for i in keep), 0]
    pk = [i for k, i in enumerate(keep, 1) if u[k] > u[k - 1] and u[k] > u[k + 1]]
    tr = [i for k, i in enumerate(keep, 1) if u[k] < u[k - 1] and u[k] < u[k + 1]]
    marks = {}
    for i in pk:
        w = np.array([v[j] if 0 <= j < len(v) else 0.0 for j in range(i - win, i + win + 1)])
        s = peaks.smoother(len(w)) @ w
        top = s[win - 1 : win + 2].max()
        marks[i] = [bool(top > s.mean()), bool(top > s.mean() + s.std(ddof=1))]
    for k in (0, 1):
        if pk and (len(pk) == 1 or not any(m[k] for m in marks.values())):
            marks[max(pk, key=lambda i: (v[i], -i))][k] = True
    out = []
    for k, i in enumerate(pk):
        out.append((2 * k + 1, "peak", t[i], v[i], *marks[i]))
        if k < len(tr) and k + 1 < len(pk):
            out.append((2 * k + 2, "trough", t[tr[k]], v[tr[k]], *marks[i]))
    return out


@pytest.mark.parametrize("win", [3, 5, 8])
def test_peaks_match_brute_force(spark, win):
    rng = np.random.default_rng(win)
    lists = {"plateau": [1, 2, 2, 1, 3, 0, 0, 4, 1], "one": [1, 2, 1], "flat": [3, 3, 3], "point": [7], "far": [9] + [0] * 30 + [8]}
    lists |= {f"r{k}": [float(x) for x in rng.random(25).round(3) * 9] for k in range(12)}
    data = [(k, float(len(v) - i), float(x)) for k, v in lists.items() for i, x in enumerate(v) if x or i in (0, len(v) - 1)]
    got = rows(peaks.find_peaks(spark.createDataFrame(data, "taxon string, t double, kdensity double"), win=win))
    want = [(k, *r) for k, v in lists.items() for r in peaks_of([float(len(v) - i) for i in range(len(v))], [float(x) for x in v], win)]
    assert got == sorted(want, key=str) and len(want) > 60


def test_kernels_are_densities_of_deviation_one(spark):
    """Each integrates to 1 and has variance 1; bandwidths scale it."""
    u = spark.range(-60_000, 60_001).select((F.col("id") / 10_000).alias("u"))
    for name, (reach, height) in density.KERNELS.items():
        y = F.when(F.abs(F.col("u")) < (reach or 99), height(F.col("u"))).otherwise(0.0)
        area, var = u.agg(F.sum(y) / 10_000, F.sum(y * F.col("u") * F.col("u")) / 10_000).first()
        assert (area, var) == pytest.approx((1, 1), abs=1e-3), name
    x = spark.createDataFrame([("a", 9.0, 1.0), ("a", 5.0, 2.0)], "genus string, max_ma double, min_ma double")
    one = density.densify(x, method="kernel", bw=1.5, kernel="triangular")
    pts = {r.p: r.w for r in density.points(x, "genus", "max_ma", "min_ma", 0.1).collect()}
    n = sum(pts.values())
    for r in one.collect():
        at = 1 + (r.t - 2) * 9 / 8  # bins from 1 to 10, places from the lower to the upper edge
        assert r.kdensity == pytest.approx(sum(w * max(0, 1 - abs(at - p) / 1.5 / 6**0.5) / 6**0.5 for p, w in pts.items()) / n / 1.5, abs=1e-6)
    half = density.densify(x, method="kernel", bw=3.0, adjust=0.5, kernel="triangular")
    assert rows(half) == rows(one)
    for bad in ({"kernel": "x"}, {"bw": "x"}, {"bw": 0}, {"adjust": 0}):
        with pytest.raises(ValueError):
            density.densify(x, **bad)


def test_threshold_splits(spark):
    x = spark.createDataFrame([("a", 50.0, 48.0)] * 5 + [("a", 12.0, 10.0)] * 5 + [("b", 7.0, 6.0), (None, 7.0, 6.0)], "genus string, max_ma double, min_ma double")
    out = peaks.threshold_ranges(x, thresh=5)
    assert {(r.genus, r.max_ma, r.split) for r in out.data.collect()} == {("a", 50.0, "a_2/2"), ("a", 12.0, "a_1/2"), ("b", 7.0, "b_1/1"), (None, 7.0, None)}
    assert rows(out.comparison) == [("a", 2, 2), ("b", 1, 1)]
    far = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "taxon string, thresh double")
    assert rows(peaks.threshold_ranges(x, thresh=far).comparison)[0] == ("a", 2, 1)
    with pytest.raises(ValueError):
        peaks.threshold_ranges(x, thresh=0)
