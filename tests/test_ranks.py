import pytest

from clastix.operators import ranks
from clastix.operators.taxonomy import check_taxonomy

from .conftest import rows


def test_discrete_ranks(spark):
    x = spark.createDataFrame([("a", "b", "c"), ("a", "a", "b"), (None, "z", "a")], "k string, p string, f string")
    assert rows(ranks.discrete_ranks(x)) == sorted([("adj", "k", "p", "a"), ("adj", "p", "f", "a"), ("adj", "p", "f", "b"), ("all", "k", "p", "a"), ("all", "k", "f", "a"), ("all", "p", "k", "a"), ("all", "p", "f", "a"), ("all", "p", "f", "b")], key=str)


def test_find_duplicates(spark):
    x = spark.createDataFrame([("F", "g"), ("E", "g"), (None, "h"), ("F", "h"), ("F", "i"), ("F", None)], "f string, g string")
    assert rows(ranks.find_duplicates(x)) == [("g", "g"), ("h", "g")]


def test_tgraph_bridges_gaps(spark):
    x = spark.createDataFrame([("A", "B", "C"), ("A", None, "D"), (None, None, "E"), (None, None, None), ("A", "B", "C")], "a string, b string, c string")
    g = ranks.tgraph(x, validate=True)
    assert rows(g.edges) == [("B", "A", 2, 1, 2), ("C", "B", 3, 2, 2), ("D", "A", 3, 1, 1)]
    assert ("C", 3, 1, 2) in rows(g.vertices) and ("A", 1, 0, 0) in rows(g.vertices)
    assert rows(ranks.neighbourhood(g, ["C"], "parent").edges) == [("B", "A", 2, 1, 2), ("C", "B", 3, 2, 2)]
    assert ranks.neighbourhood(g, ["A"], "child", 1).edges.count() == 2
    with pytest.raises(ValueError):
        ranks.tgraph(spark.createDataFrame([("A", "A")], "a string, b string"), validate=True)


ASSESS = [
    ([(("K", "P", "x"), 1), (("K", "Q", "x"), 1), (("K", "R", "x"), 1)], "three parents"),
    ([(("K", "P", "x"), 1), (("L", "Q", "x"), 1)], "no common ancestor"),
    ([(("K", "P", "x"), 2), (("K", None, "x"), 1)], "rank skipped"),
    ([(("K", "P", "x"), 2), (("K", "Q", "x"), 1)], "equal paths"),
    ([(("K", "P", None, "x"), 1), (("K", None, "Q", "x"), 1)], "made one"),
    ([(("K", "C", "O", "x"), 2), (("K", "D", "P", "x"), 1)], "frequency"),
    ([(("K", "C", "O", "F", "x"), 2), (("K", "D", "P", "G", "x"), 1)], "too far"),
]


@pytest.mark.parametrize("lines, want", ASSESS)
def test_assess(lines, want):
    assert want in ranks.assess(lines, jump=3 if want != "too far" else 2)[0]


def test_resolution(spark):
    x = spark.createDataFrame([("K", "P", "x"), ("K", "P", "x"), ("K", "Q", "x"), ("K", None, "y"), ("K", "Q", "y"), ("K", "P", "z"), ("L", "R", "z"), (None, None, "z"), ("K", "P", None)], "a string, b string, c string")
    got = rows(ranks.resolve_duplicates(x))
    assert got.count(("K", "P", "x")) == 3 and got.count(("K", "Q", "y")) == 2
    assert ("K", "P", "zA") in got and ("L", "R", "zB") in got and (None, None, "z") in got and ("K", "P", None) in got
    assert len(got) == 9


def test_resolution_keeps_clashing_columns(spark):
    x = spark.createDataFrame([("K", "P", "x", 1, 2), ("K", "Q", "x", 3, 4), ("K", "P", "x", 5, 6)], "a0 string, b string, c0 string, hit int, o0 int")
    out = ranks.resolve_duplicates(x, ["a0", "b", "c0"])
    assert out.columns == x.columns and rows(out) == [("K", "P", "x", 1, 2), ("K", "P", "x", 3, 4), ("K", "P", "x", 5, 6)]
    assert ranks.resolve_duplicates(x.limit(0), ["a0", "b", "c0"]).isEmpty()


def test_shared_folder_on_a_cluster_must_be_named(spark, monkeypatch):
    from types import SimpleNamespace

    from clastix import shared

    conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    on = lambda master, conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared.shared_dir(on("yarn", conf)) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared.shared_dir(on("yarn", {}))
    with shared.collected() as made:
        t = shared.written(spark.range(3), "t")
    assert made == [t] and t.count() == 3
    shared.drop(t)
    shared.drop(t)


def test_completeness_mode():
    lines = [(("K", None, "O", "x"), 5), (("K", "D", "P", "x"), 1)]
    assert ranks.assess(lines, "completeness", 4)[1] == [("x", "O")]
    assert ranks.assess(lines, "frequency", 4)[1] == [("x", "P")]


def test_check_taxonomy(spark):
    x = spark.createDataFrame([(1, "Brach", "Discinidae"), (2, "Brach", "Discinidae"), (3, "Brach", "Disciniidae"), (4, "Moll", "Discinidae"), (5, "Moll", "bad name 3")], "id long, phylum string, family string")
    out = check_taxonomy(x, ["phylum", "family"], "id", clean_name=True, clean_spell=True, thresh=0.5, resolve_duplicates=True)
    assert ("word_count", "family", 5) in rows(out.formatting)
    assert rows(out.synonyms.select("t1", "t2")) == [("Discinidae", "Disciniidae")]
    assert rows(out.duplicates) == [("Discinidae", "family")]
    got = {r.id: r.family for r in out.data.collect()}
    assert got == {1: "DiscinidaeA", 2: "DiscinidaeA", 3: "DiscinidaeA", 4: "DiscinidaeB", 5: "Bad name"}
    plain = check_taxonomy(x, ["phylum", "family"], "id", routine=("find_duplicates",), resolve_duplicates=True, append=False)
    assert plain.synonyms.isEmpty() and {r.family for r in plain.data.where("id < 5").collect()} == {"Discinidae", "Disciniidae"}
