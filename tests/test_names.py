import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clastix.functions import text
from clastix.operators import names

from .conftest import rows


@pytest.mark.parametrize("x, want", [("Foo (Bar) baz", "Foo baz"), ("NO_FAMILY_SPECIFIED", "No"), ("Genus sp. 1", "Genus"), ("", None), (None, None), ("GENUS XVI", "Genus"), ("Genus CCDT", "Genus"), ("one two three", "One"), ("b", None), ("Aff. Genus? nova", "Genus nova")])
def test_clean_name(spark, x, want):
    df = spark.createDataFrame([(x,)], "x string").select(names.clean_name(F.col("x")).alias("y"))
    assert df.first().y == want


def test_clean_name_terms(spark):
    df = spark.createDataFrame([("Genus informal",), ("Genus_x y",)], "x string")
    assert [r.y for r in df.select(names.clean_name(F.col("x"), ["informal"], ["_x"]).alias("y")).collect()] == ["Genus", "Genus"]


def test_format_check(spark):
    x = spark.createDataFrame([(1, "Genus", "one two"), (2, "Gen us", "one"), (3, None, "one two "), (4, "", "a_b")], "id long, g string, s string")
    got = rows(names.format_check(x, ["g", "s"], "id", species=True, species_sep="_"))
    assert got == [("word_count", "g", 2), ("word_count", "g", 4), ("word_count", "s", 2)]
    assert ("non_letter", "g", 2) in rows(names.format_check(x, ["g"], "id"))


PAIRS = [("Disciniidae", "Discinidae", 0.0303), ("Ptychomalotoechia", "Ptychomaletoechia", 0.06), ("Hipparionix", "Hipparionyx", 0.0606), ("Sphaenospira", "Sphenospira", 0.0278)]


@pytest.mark.parametrize("a, b, d", PAIRS)
def test_jaro(a, b, d):
    assert 1 - text.jaro(a, b) == pytest.approx(d, abs=1e-3) == 1 - text.jaro(b, a)


def test_distances():
    d = text.distance
    assert d("ab", "ba", "lv") == 2 and d("ab", "ba", "osa") == 1 and d("ca", "abc", "osa") == 3 and d("ca", "abc", "dl") == 2
    assert d("abc", "abd", "hamming") == 1 and d("abc", "ab", "hamming") == float("inf") and d("abc", "adc", "lcs") == 2
    assert d("abc", "abd", "qgram") == 2 and d("abc", "abd", "jaccard") == 0.5 and d("aa", "aa", "cosine") == pytest.approx(0)
    assert text.soundex("Robert") == text.soundex("Rupert") == "R163" and d("Robert", "Rubin", "soundex") == 1
    assert text.nearest_window("xxabcxx", "abc") == 0 and text.nearest_window("ab", "abc") == pytest.approx(1 / 3)


def test_spell_check(spark):
    x = spark.createDataFrame([("Discinidae", "Brach"), ("Discinidae", "Brach"), ("Disciniidae", "Brach"), ("Discinidae", "Other"), (None, "Brach"), ("Disciniidaf", None)], "family string, phylum string")
    got = names.spell_check(x, "family", "phylum").collect()
    assert [(r.t1, r.t2, r.group, r.freq1, r.freq2) for r in got] == [("Discinidae", "Disciniidae", "Brach", 3, 1)]
    assert names.spell_check(x, "family", "phylum", str2=4, pref=["Disci"], exclude=["Brach"]).isEmpty()
    assert names.spell_check(x, "family", "phylum", suff=["iidae"]).isEmpty()
    assert rows(names.replacements(spark.createDataFrame(got), 0.5)) == [("Disciniidae", "Discinidae")]
    assert names.replacements(spark.createDataFrame(got), 0.0).isEmpty()


def test_replacements_follow_chains(spark):
    pairs = [(f"t{k:02}", f"t{k + 1:02}", 0.0, k + 1, k + 2) for k in range(20)] + [("t00", "t05", 0.0, 1, 6), ("same", "as", 0.0, 3, 3), ("x", "y", 0.9, 1, 2)]
    got = dict(rows(names.replacements(spark.createDataFrame(pairs + pairs[:3], "t1 string, t2 string, m2 double, freq1 long, freq2 long"), 0.5)))
    assert got == {f"t{k:02}": "t20" for k in range(20)}
    x = spark.createDataFrame([("t03", 1, 2), (None, 3, 4), ("z", 5, 6)], "name string, old int, new int")
    to = spark.createDataFrame(list(got.items()), "old string, new string")
    assert rows(names.replace_names(x, "name", to)) == [("t20", 1, 2), ("z", 5, 6), (None, 3, 4)] or rows(names.replace_names(x, "name", to)) == sorted([("t20", 1, 2), ("z", 5, 6), (None, 3, 4)], key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=9), st.text("abcé", max_size=9)), max_size=8))
def test_jaro_side_by_side(pairs):
    assert text.jaro_of([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx([text.jaro(a, b) for a, b in pairs])


@pytest.mark.parametrize("method", ["lv", "hamming", "jaccard"])
def test_built_in_distances(spark, method):
    pairs = [("xxabcxx", "abc"), ("ab", "abc"), ("abcd", "badc"), ("héllo", "hello"), ("a", "a"), ("aab", "b"), ("a.b\nc", ".b\n")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.window_distance(method, 1)(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([text.nearest_window(a, b, method, 1) for a, b in pairs])
