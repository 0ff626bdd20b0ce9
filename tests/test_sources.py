import pytest

from clastix.sources import occurrences as S
from clastix.streaming import flags

from .conftest import rows


def test_urls():
    (u,) = S.build_urls("Trilobita", (450, 440))
    assert u == S.BASE + "occs/list.csv?base_name=Trilobita&max_ma=450&min_ma=440"
    assert S.build_urls(interval=("Early", "Late"), tscale={"Early": (30.0, 20.0), "Late": (20.0, 10.0)})[0].endswith("max_ma=30&min_ma=10")
    assert S.build_urls("X", pres="form", idqual="new", area=(-10, 10, -5, 5))[0].endswith("base_name=X&pres=form&idqual=new&lngmin=-10&lngmax=10&latmin=-5&latmax=5")
    assert S.build_urls("X", ex_area=["US"], env=["reef", "nonsense"])[0].endswith("cc=!US&envtype=reef")
    assert S.build_urls("X", fields=["full", "a", "zzz"], vocabulary={"bulk": ["full"], "full": ["a", "b"]})[0].endswith("show=full")


def test_chunks():
    assert S.chunks(700, 480) == [(700, 600), (600, 500), (500, 480)]
    assert S.chunks(1000, 450)[0] == (1000, 600)
    assert S.chunks(90, 10) == [(90, 10)]


@pytest.mark.parametrize("kw", [{}, {"taxon": "a", "ex_taxon": "a"}, {"taxon": "a", "mode": "x"}, {"taxon": "a", "res": "x"}, {"taxon": "a", "area": (10, -10, 0, 1)}, {"taxon": "a", "litho": ["x"]}])
def test_bad_requests(kw):
    with pytest.raises(ValueError):
        S.build_urls(**kw)


def test_files(spark, tmp_path):
    head = "occurrence_no,phylum,early_interval,late_interval,max_ma,min_ma\n"
    (tmp_path / "a.csv").write_text(head + '1,Mollusca,Early,"",9,8\n2,Other,Nowhere,"",7,6\n')
    (tmp_path / "b.csv").write_text(head + '2,Other,Nowhere,"",7,6\n3,"",Early,Early,1,0\n')
    scale = spark.createDataFrame([("Early", 30.0, 20.0)], "Interval string, FAD double, LAD double")
    df = S.read_occurrences(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], tscale=scale, kingdoms={"Animalia": ["Mollusca"]})
    assert rows(df.select("occurrence_no", "kingdom", "phylum", "max_ma", "min_ma")) == [("1", "Animalia", "Mollusca", 30.0, 20.0), ("2", None, "Other", 7.0, 6.0), ("3", None, None, 30.0, 20.0)]
    S.write_occurrences(df, str(tmp_path / "out"))
    assert S.read_occurrences(spark, str(tmp_path / "out")).count() == 3


def test_download(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text(f'occurrence_no,phylum\r\n{k},"a, é"\r\n3,\r\n', encoding="utf-8")
    urls = [(tmp_path / f"{k}.csv").as_uri() for k in (1, 2, 1)]
    out = S.read_occurrences(spark, S.download(spark, urls, str(tmp_path / "got")))
    assert rows(out) == [("1", "a, é"), ("2", "a, é"), ("3", None)]
    with pytest.raises(Exception, match="missing"):
        S.download(spark, [(tmp_path / "missing").as_uri()], str(tmp_path / "none"))


def test_range_stream(spark, tmp_path):
    x = spark.createDataFrame([("a", 3.0, 1.0), ("a", 5.0, 2.0), (None, 9.0, 9.0)], "genus string, max_ma double, min_ma double")
    x.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    flags.range_stream(stream).writeStream.format("memory").queryName("ranges_so_far").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("ranges_so_far")) == [("a", 5.0, 1.0)]
