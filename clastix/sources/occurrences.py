"""Occurrence records from a list service: its addresses, and the files downloaded from it."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ages import add_kingdoms, chrono_scale
from ..schema import require
from ..shared import fresh

BASE = "https://paleobiodb.org/data1.2/"
MODES = {
    "occurrence": "occs/list.csv?",
    "collection": "colls/list.csv?",
    "taxa": "occs/taxa.csv?",
    "specimen": "specs/list.csv?",
    "measurement": "specs/measurements.csv?",
    "strata": "occs/strata.csv?",
    "diversity": "diversity.csv?",
    "opinion": "occs/opinions.csv?",
    "reference": "occs/refs.csv?",
}
RESOLUTIONS = tuple("all species genus family lump_subgen lump_genus".split())
LITHOLOGIES = frozenset("siliciclastic mixed carbonate evaporite organic chemical volcanic metasedimentary metamorphic other unknown".split())
ENVIRONMENTS = frozenset("terrestrial marine carbonate siliciclastic unknown lacustrine fluvial karst terrother marginal reef stshallow stdeep offshore slope marindet".split())
#: A span of ages longer than this many million years is asked for in parts; what is older than OLD in one.
CHUNK, OLD = 100, 601


def _list(x: str | Iterable[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(dict.fromkeys(y for y in x if y is not None))


def ages_of(interval: str | tuple, tscale: dict[str, tuple[float, float]] | None = None) -> tuple[float, float]:
    """(oldest, youngest) age of one or two named intervals or of numbers."""
    parts = _list(interval) if isinstance(interval, str) or isinstance(interval[0], str) else list(interval)
    if isinstance(parts[0], str):
        for p in (parts[0], parts[-1]):
            if p not in (tscale or {}):
                raise ValueError(f"the time scale has no interval {p!r}")
        return tscale[parts[0]][0], tscale[parts[-1]][1]
    return max(parts), min(parts)


def chunks(oldest: float, youngest: float) -> list[tuple[float, float]]:
    """The spans of ages that are asked for one by one."""
    if oldest - youngest <= CHUNK:
        return [(oldest, youngest)]
    edges = [oldest]
    while edges[-1] - CHUNK >= youngest:
        edges.append(edges[-1] - CHUNK)
    if oldest > OLD:
        edges = [oldest, *(e for e in edges if e < OLD)]
    if edges[-1] > youngest:
        edges.append(youngest)
    return list(zip(edges, edges[1:]))


def _signed(wanted: list[str], unwanted: list[str], invert: bool, what: str) -> str | None:
    if both := set(wanted) & set(unwanted):
        raise ValueError(f"{what} {sorted(both)} are asked for and excluded")
    if wanted:
        out = ("!" if invert else "") + ",".join(wanted)
        return out + "".join(f",^{x}" for x in unwanted)
    return "!" + ",".join(unwanted) if unwanted else None


def _known(names: list[str], vocabulary: Iterable[str] | None, what: str) -> list[str]:
    kept = names if vocabulary is None else [x for x in names if x in vocabulary]
    if names and not kept:
        raise ValueError(f"none of {names} is a valid {what}")
    return kept


def build_urls(
    taxon: str | list[str] | None = None,
    interval: str | tuple | None = None,
    mode: str = "occurrence",
    res: str = "all",
    fields: list[str] | None = None,
    ex_taxon: str | list[str] | None = None,
    area: list[str] | tuple[float, float, float, float] | None = None,
    ex_area: list[str] | None = None,
    invert_area: bool = False,
    litho: list[str] | None = None,
    invert_litho: bool = False,
    env: list[str] | None = None,
    ex_env: list[str] | None = None,
    invert_env: bool = False,
    pres: str | None = None,
    idqual: str | None = None,
    tscale: dict[str, tuple[float, float]] | None = None,
    places: Iterable[str] | None = None,
    vocabulary: dict[str, list[str]] | None = None,
    base: str = BASE,
) -> list[str]:
    """The addresses that list what is asked for, one for each span of ages.

    Names that a given vocabulary (fields by group, places) lacks are dropped; a group of fields stands
    for its members. area is of names or (west, east, south, north) in degrees.
    """
    if taxon is None and interval is None:
        raise ValueError("give a taxon or an interval at least")
    if mode not in MODES:
        raise ValueError(f"mode is one of {sorted(MODES)}")
    if res not in RESOLUTIONS:
        raise ValueError(f"res is one of {RESOLUTIONS}")
    taxa, without = _list(taxon), _list(ex_taxon)
    if set(taxa) & set(without):
        raise ValueError("a taxon is asked for and excluded")
    head = []
    if taxa:
        head.append("base_name=" + " ".join([",".join(taxa), *(f"^{x}" for x in without)]))
    for key, value in (("pres", pres), ("idqual", idqual)):
        if value:
            head.append(f"{key}={value}")
    if res != "all":
        head.append(f"taxon_reso={res}")
    tail = []
    show = _list(fields)
    if vocabulary is not None:
        show = [f for f in show if any(f in v for v in vocabulary.values())]
        inside = {m for g in vocabulary.get("bulk", []) if g in show for m in vocabulary.get(g, [])}
        show = [f for f in show if f not in inside]
    if show:
        tail.append("show=" + ",".join(show))
    if area is not None and not isinstance(area[0], str):
        west, east, south, north = area
        if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
            raise ValueError("area is west, east, south, north in degrees, in order")
        tail.append(f"lngmin={west}&lngmax={east}&latmin={south}&latmax={north}")
    elif land := _signed(_known(_list(area), places, "area"), _known(_list(ex_area), places, "area"), invert_area, "areas"):
        tail.append("cc=" + land)
    if rock := _known(_list(litho), LITHOLOGIES, "lithology"):
        tail.append("lithology=" + ("!" if invert_litho else "") + ",".join(rock))
    if place := _signed(_known(_list(env), ENVIRONMENTS, "environment"), _known(_list(ex_env), ENVIRONMENTS, "environment"), invert_env, "environments"):
        tail.append("envtype=" + place)
    spans = [f"max_ma={a:g}&min_ma={b:g}" for a, b in chunks(*ages_of(interval, tscale))] if interval is not None else [None]
    return [base + MODES[mode] + "&".join([*head, *([s] if s else []), *tail]) for s in spans]


def download(spark: SparkSession, urls: list[str], path: str, wait: float = 0.0, timeout: float = 300.0) -> str:
    """Downloads each address as a file of folder path, for read_occurrences(), an address in a task; returns path.

    wait: seconds that a task waits before it asks, for each address before its own. What a server refuses is an
    error. Without an address the folder is empty. A repeated address is asked once.
    """
    asked = list(dict.fromkeys(urls))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                time.sleep(wait * k)
                with urllib.request.urlopen(asked[k], timeout=timeout) as body:  # noqa: S310
                    while lines := body.readlines(4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8").rstrip("\r\n") for x in lines])], names=["value"])

    spark.range(0, len(asked), 1, max(1, len(asked))).mapInArrow(fetch, "value string").write.mode("overwrite").text(path)
    return path


def read_occurrences(spark: SparkSession, paths: str | list[str], schema: str | None = None, key: str = "occurrence_no", tscale: DataFrame | None = None, kingdoms: dict[str, list[str]] | None = None) -> DataFrame:
    """Downloaded lists (CSV with a header, UTF-8) as one table: empty texts are null, each key is there once.

    A record that lies on the edge of two spans comes in both. With tscale max_ma and min_ma are replaced
    by the ages of the named intervals, where it has them; with kingdoms a kingdom column is added.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", "").option("emptyValue", "")
    df = (reader.schema(schema) if schema else reader).csv(paths)
    require(df, key)
    df = df.dropDuplicates([key])
    if tscale is not None:
        df = df.withColumns({c: F.col(c).cast("double") for c in ("max_ma", "min_ma")})
        new = fresh(df, "newFAD", "newLAD")
        df = chrono_scale(df, tscale, max_ma="max_ma", min_ma="min_ma").withColumns({"max_ma": F.col(new[0]), "min_ma": F.col(new[1])}).drop(*new)
    return add_kingdoms(df, kingdoms) if kingdoms else df


def write_occurrences(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
