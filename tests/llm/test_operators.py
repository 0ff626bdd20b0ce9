"""Whole operators: nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns, brute force."""

import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clastix.llm import decontaminate, html, jaccard, language, licenses, packing, pii, quality, queries, scratch, secrets, toxicity

from ..conftest import rows
from ..oracle import connect, same

WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, language string, bin int, keep boolean"
EMPTY_PAGES = "page_id long, url string, html string, h string, host string"


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = text(99, 40_000)
RAW = [
    (1, text(1, 80), "en"),
    (1, text(1, 80), "en"),
    (2, text(1, 80) + " one more", "en"),
    (3, text(2, 60), "fr"),
    (4, None, None),
    (None, text(2, 60), "fr"),
    (5, "", "en"),
    (6, " \n ", None),
    (7, "ab", "en"),
    (8, "ab", "en"),
    (9, LONG, "en"),
    (10, LONG + " tail", "en"),
    (11, text(3, 50) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mail a.b@mail.example.com', "de"),
    (12, text(4, 30) + "\n" + text(50, 20) + "\nReleased under the MIT License.", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows_ = [(i, t, g, f"s{k}", len(t) if t is not None else None, 7, "x", "l", 1, True) for k, (i, t, g) in enumerate(RAW)]
    return spark.createDataFrame(rows_, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, text(50, 20), "x"), (1, text(50, 20), "x"), (2, None, "x"), (3, "", "x"), (None, text(2, 60), "x"), (4, "of the", "x"), (5, " ".join(text(3, 50).split()[:9]), "x")], "item_id long, text string, id string")


def grams(t: str) -> set:
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(texts) -> dict:
    sets = [(i, grams(t)) for i, t in texts if i is not None and grams(t)]
    out = {}
    for a, x in sets:
        for b, y in sets:
            if a < b and len(x & y) / len(x | y) >= jaccard.THRESHOLD:
                out[a, b] = max(len(x & y) / len(x | y), out.get((a, b), 0))
    return out


def test_jaccard_edges(docs, empty):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.all_pairs(jaccard.join(docs)).collect()}
    assert got == pytest.approx(similar([(i, t) for i, t, _ in RAW])) and (1, 2) in got and (9, 10) in got and got[7, 8] == 1
    assert jaccard.all_pairs(jaccard.join(empty)).isEmpty()
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None, 5, 6, 7, 9, 11, 12], key=str)
    assert jaccard.deduplicated(empty).isEmpty()


@pytest.mark.parametrize("threshold, hot, bytes_", [(0.3, 2000, 8 << 20), (0.8, 2000, 8 << 20), (0.3, 3, 1500), (0.8, 2, 400)])
def test_jaccard_brute_force(spark, monkeypatch, threshold, hot, bytes_):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(jaccard, "CELL_TEXTS", 5)
    monkeypatch.setattr(jaccard, "HOT_TEXTS", hot)
    monkeypatch.setattr(jaccard, "CELL_BYTES", bytes_)
    monkeypatch.setattr(jaccard, "VERIFY_BYTES", 5000)
    rng = random.Random(5)
    base = [text(k, 40).split() for k in range(12)]
    texts = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice("abcdef") * 3
        texts.append((i, " ".join(w[: rng.choice([40, 40, 30, 3])])))
    monkeypatch.setattr(jaccard, "THRESHOLD", threshold)
    found = jaccard.join(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), threshold=threshold)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.all_pairs(found).collect()}
    want = similar(texts)
    assert got == pytest.approx(want) and len(want) > 30
    part = {i: i for i, _ in texts}
    for a, b in sorted(want):
        a, b = part[a], part[b]
        part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    assert sorted(r.id for r in jaccard.losers(found).collect()) == sorted(k for k, v in part.items() if k != v)


@pytest.mark.parametrize("threshold, tile, most", [(0.3, 1000, 10**6), (0.4, 7, 10**6), (0.8, 3, 10**6), (0.4, 7, 30)])
def test_links_of_families_brute_force(spark, monkeypatch, threshold, tile, most):
    """Groups of near copies of 4 texts or more, counted in tiles of few texts, in parts of hot n-grams; most: texts of families at most, the rest goes by prefixes."""
    for k, v in {"FAMILY": 4, "FAMILY_TEXTS": most, "ALIKE": 2, "TILE_TEXTS": tile, "DENSE": 5, "COLUMNS": 7, "HOT_TEXTS": 6, "BLOCK_GRAMS": 900, "CELL_TEXTS": 5, "THRESHOLD": threshold}.items():
        monkeypatch.setattr(jaccard, k, v)
    made = []
    monkeypatch.setattr(jaccard, "_within", lambda *x, f=jaccard._within: made.append(f(*x)) or made[-1])
    rng = random.Random(7)
    base = [text(k, 60).split() for k in range(6)]
    texts = []
    for i in range(140):
        w = list(base[min(5, int(rng.expovariate(0.6)))])
        for _ in range(rng.choice([0, 1, 2, 4, 7])):
            w[rng.randrange(len(w))] = rng.choice("abcdef") * 3
        texts.append((i, " ".join(w[: rng.choice([60, 60, 60, 45, 25, 3])])))
    texts += [(200, None), (201, ""), (202, "..."), (None, texts[0][1]), (203, texts[0][1]), (203, texts[0][1])]
    got = {r.id: (r.class_id, r.links) for r in jaccard.links(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), threshold=threshold).collect()}
    want, part, links = similar(texts), {i: i for i, _ in texts if i is not None}, collections.Counter()
    for a, b in sorted(want):
        links.update((a, b))
        a, b = part[a], part[b]
        part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    assert got == {i: (c, links[i]) for i, c in part.items()}
    assert len(made) == 1 and 0 < made[0].where("kind = 1").count() < len(want) / 4


@pytest.fixture
def pairs_made(monkeypatch):
    """The numbers of pairs that the join writes."""
    made = []

    def written(df, name, *by, f=jaccard.written):
        out = f(df, name, *by)
        if name == "similar":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    return made


def family(n: int) -> list[tuple[int, str]]:
    base, rng = text(1, 150).split(), random.Random(3)
    return [(k, " ".join(rng.choice("abcdefgh") * 3 if rng.random() < 0.02 else w for w in base)) for k in range(n)]


def test_deduplicated_makes_few_pairs_of_a_large_family(spark, pairs_made):
    """900 near copies of one text have more than 300,000 similar pairs."""
    kept = jaccard.deduplicated(spark.createDataFrame([*family(900), (1000, text(2, 50))], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000] and pairs_made[0] < 40_000


def test_links_of_a_large_family_are_all_counted(spark, pairs_made):
    texts = family(900)
    got = jaccard.links(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == 900 and sum(r.links for r in got) == 2 * len(similar(texts)) > 600_000
    assert pairs_made[0] < 40_000


def test_one_text_stands_for_an_id(spark):
    a, b = text(1, 30), text(2, 30)
    table = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, a + " x"), (5, b + " x")], "doc_id long, text string")
    got = {(r.doc_a, r.doc_b) for r in jaccard.all_pairs(jaccard.join(table)).collect()}
    assert got in ({(1, 2), (1, 4), (2, 4), (3, 5)}, {(1, 3), (1, 5), (3, 5), (2, 4)})


def test_chain_of_similar_texts_is_one_group(spark):
    pairs = spark.createDataFrame([(k, k + 1, 1, 1, 1, 1.0) for k in range(1, 40)] + [(100, 101, 1, 1, 1, 1.0)], jaccard._FOUND)
    copies = spark.createDataFrame([(40, 40), (40, 41), (40, 42)], "id long, member long")
    assert sorted(r.id for r in jaccard.losers(jaccard.Similar(copies, pairs)).collect()) == [*range(2, 43), 101]


def longest_match(t: str, item: str) -> tuple | None:
    """(words, place in the text, place in the item) of the longest match that counts, by trying every pair of places."""
    d, w = WORD.findall(t.lower()), WORD.findall(item.lower())
    need = min(decontaminate.MIN_WORDS, len(w))
    found = []
    for a in range(len(d)):
        for b in range(len(w)):
            k = 0
            while a + k < len(d) and b + k < len(w) and d[a + k] == w[b + k]:
                k += 1
            if k >= need >= decontaminate.LEAST:
                found.append((-k, a, b))
    return (-min(found)[0], *min(found)[1:]) if found else None


def test_decontamination_of_repeated_words_is_quick(spark):
    """A megabyte of one word, and of two in turn, against items of the same: every place matches every place."""
    junk = spark.createDataFrame([(1, "the " * 300_000), (2, "to be " * 200_000), (3, text(7, 30))], "doc_id long, text string")
    items = spark.createDataFrame([(k, "the " * (100 + k)) for k in range(5)] + [(9, "be to " * 60)], "item_id long, text string")
    began = time.perf_counter()
    got = rows(decontaminate.matches(junk, items))
    assert got == [*[(1, k, 100 + k, 0, 0) for k in range(5)], (2, 9, 120, 1, 0)]
    assert time.perf_counter() - began < 20


def test_decontamination_edges(docs, empty, bench):
    items = [(1, text(50, 20)), (3, ""), (4, "of the"), (5, " ".join(text(3, 50).split()[:9]))]
    want = sorted({(i, k, *m) for i, t, _ in RAW if i is not None and t for k, other in items if (m := longest_match(t, other))}, key=str)
    assert rows(decontaminate.matches(docs, bench)) == want and {r[:2] for r in want} == {(11, 5), (12, 1)}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {1, 9, None, 4, 5} <= {r.doc_id for r in kept.collect()} and 12 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.matches(empty, bench).isEmpty() and decontaminate.matches(docs, bench.limit(0)).isEmpty()


def test_decontamination_in_parts(docs, bench, monkeypatch):
    whole = rows(decontaminate.matches(docs, bench))
    monkeypatch.setattr(decontaminate, "TEST_BYTES", 50)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    assert rows(decontaminate.matches(docs, bench)) == whole


def test_language(spark, docs, empty, sf_dir):
    model = language.fit(docs)
    got = {(r.doc_id, r.language, r.keep) for r in language.identify(docs, model).collect()}
    assert {(4, "und", False), (5, "und", False), (6, "und", False)} <= got and language.identify(docs, model).count() == len(RAW)
    assert language.kept(docs, model).columns == docs.columns and language.kept(docs, model).where("doc_id IN (4, 5, 6)").isEmpty()
    assert language.identify(empty, model).isEmpty()
    nothing = language.fit(empty)
    assert nothing.languages == () and not language.identify(docs, nothing).where("keep").count()
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(real.where("doc_id % 2 = 0"))
    held = real.where("doc_id % 2 = 1").join(language.identify(real, model), "doc_id")
    assert held.where("lang = language").count() >= 0.97 * held.count() and held.where("keep").count() == held.count()


FOREIGN = {
    "fi": "Suomen kieli kuuluu itämerensuomalaisiin kieliin, ja sitä puhutaan pääasiassa Suomessa. Kieli on läheistä sukua virolle ja karjalalle, ja sen rakenne poikkeaa selvästi naapurimaiden kielistä. Monet sanat taivutetaan useissa sijamuodoissa.",
    "tr": "Türkçe, Türkiye'de ve Kıbrıs'ta konuşulan bir dildir. Bu dilin yapısı sondan eklemelidir ve ünlü uyumu önemli bir yer tutar. Çocuklar okulda yazmayı ve okumayı öğrenir, sonra kitaplar okurlar.",
    "pl": "Język polski należy do grupy języków zachodniosłowiańskich i jest używany głównie w Polsce. Wiele osób uczy się go także za granicą, ponieważ ich rodziny pochodzą z tego kraju. Wczoraj wieczorem padał deszcz.",
    "sv": "Det svenska språket talas främst i Sverige och i delar av Finland. Många människor läser böcker på biblioteket, och barnen går i skolan varje dag. I går kväll regnade det mycket i staden.",
    "code": "def main(args): for i in range(len(args)): if args[i] == None: continue; result.append(parse(args[i])); return json.dumps(result, indent=2); class Foo(object): def __init__(self, x): self.x = x",
}


def test_language_rejects_languages_without_labels(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(real.where("doc_id % 2 = 0"))
    foreign = spark.createDataFrame(list(FOREIGN.items()), "doc_id string, text string")
    assert {(r.doc_id, r.language, r.keep) for r in language.identify(foreign, model).collect()} == {(k, "und", False) for k in FOREIGN}
    held = language.identify(real.where("doc_id % 2 = 1 AND text RLIKE '[A-Za-z]'"), model)
    assert held.where("NOT keep").isEmpty()


def test_language_fit_counts_by_hand(spark, sf_dir):
    """The matrix from n-grams counted one by one, of all labelled texts: there are fewer than the sample."""
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "lang", "text")
    model = language.fit(docs)
    counts = np.zeros(((1 << language.BUCKET_BITS) + 1, len(model.languages)))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.lang] += 1
        chars = []
        for c in r.text.lower():
            c = c if "a" <= c <= "z" or c >= "\x80" else " "
            if c != " " or not chars or chars[-1] != " ":
                chars.append(c)
        for n in language.ORDERS:
            for i in range(len(chars) - n + 1):
                if n > 1 or chars[i] != " ":
                    h = 0
                    for k in range(n):
                        h = ((h ^ ord(chars[i + k])) * int(language._MUL[k])) & 0xFFFFFFFF
                        h ^= h >> 15
                    h = (h * 0x27D4EB2F + n) & 0xFFFFFFFF
                    counts[h >> (32 - language.BUCKET_BITS), model.languages.index(r.lang)] += 1
    want = np.log((counts[:-1] + language.SMOOTHING) / (counts[:-1] + language.SMOOTHING).sum(0))
    assert np.abs(model.log_probs[:-1] - want).max() < 1e-4
    assert model.log_prior.tolist() == pytest.approx([math.log(sizes[k] / sum(sizes.values())) for k in model.languages])


def test_language_is_naive_bayes_by_hand(docs):
    model = language.fit(docs)
    t = "la vie"
    (i, j, grams_, at), *_ = language._features(__import__("pyarrow").array([t]))
    by_hand = [sum(float(model.log_probs[g, k]) for n in grams_ for g in n) for k in range(len(model.languages))]
    like, n = language.scores(model, __import__("pyarrow").array([t]))
    assert like[0].tolist() == pytest.approx(by_hand) and n[0] == 5 + 5 + 4


def test_secrets(spark, docs, empty):
    assert [(r.doc_id, r.n_chars) for r in secrets.scan(docs).collect()] == [(11, 40)]
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    r = out.where("doc_id = 11").first()
    assert '"<secret>"' in r.text and "24be64" not in r.text and r.n_chars == len(r.text)
    before, after = rows(docs.where("doc_id <> 11 OR doc_id IS NULL")), rows(out.where("doc_id <> 11 OR doc_id IS NULL"))
    assert before == after and secrets.scan(empty).isEmpty() and secrets.redacted(empty).isEmpty()


def test_secret_query_against_brute_force(spark):
    """Every stretch of every document tried as a candidate, features and votes of the trees counted one by one."""
    run = re.compile(r"[A-Za-z0-9+/_-]")
    names = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "credential")
    known = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "sk-", "sk_", "AIza", "eyJ", "npm_", "pypi-")

    def spans(t):
        out, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and run.match(t[j]):
                j += 1
            if j - i >= 16:
                end = j
                while end < len(t) and end < j + 2 and t[end] == "=":
                    end += 1
                s = t[i:end]
                if s.startswith(known) or (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                    out.append((i, end))
            i = max(j, i + 1)
        low = t.lower()
        for k in range(len(t)):
            for name in names:
                if low.startswith(name, k):
                    m = re.match(r"s?[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]+)", t[k + len(name) :])
                    if m:
                        out.append((k + len(name) + m.start(1), k + len(name) + m.end(1)))
        best: list = []
        for a, z in sorted(set(out), key=lambda x: (x[0], -x[1])):
            if not best or a >= best[-1][1]:
                best.append((a, z))
        return best

    forest = secrets.train()

    def vote(x):
        total = 0.0
        for root in forest.roots.tolist():
            while forest.left[root] != root:
                root = int(forest.left[root] if x[forest.feature[root]] <= forest.cut[root] else forest.right[root])
            total += forest.value[root]
        return total / len(forest.roots)

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        for a, z in spans(r.text):
            p = vote(secrets.features(r.text[a:z], r.text[max(0, a - secrets.NEAR) : a], r.text[z : z + secrets.NEAR], r.source))
            if p >= secrets.THRESHOLD:
                want[r.doc_id, a, z - a] = p
    got = {(r.doc_id, r.start, r.n_chars): r.probability for r in queries.op2_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    assert got == pytest.approx(want, abs=1e-6) and want


def test_secret_scan_without_a_path_and_of_repeated_rows(spark, docs):
    plain = docs.select("doc_id", "text")
    assert [(r.doc_id, r.n_chars) for r in secrets.scan(plain.unionByName(plain)).collect()] == [(11, 40)] * 2
    assert secrets.redacted(plain).where("doc_id = 11").first().text.count(secrets.MARK) == 1


def test_html_query_against_brute_force(spark, sf_dir):
    """Votes counted in a loop over the hosts, each page extracted anew by the path its host's pages agree on."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    host = {r.page_id: r.url.split("://")[1].split("/")[0].removeprefix("www.") for r in pages}
    best = {r.page_id: html.best(r.html) for r in pages}
    votes = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in pages:
        if best[r.page_id]:
            votes[host[r.page_id]][best[r.page_id][0]].append(best[r.page_id][1])
    won = {}
    for h, paths in votes.items():
        top = min((-len(v), -sum(math.floor(x + 0.5) for x in v), k) for k, v in paths.items())
        if -top[0] >= html.LEAST_VOTES:
            won[h] = top[2]

    def inside(page, wanted):
        """The text of containers of the path, by a stack of names."""
        path, out, deep, quiet, found = [], [], 0, 0, False
        for what, value, attributes in html.events(page):
            if what == "text":
                if deep and not quiet:
                    out.append(re.sub(r"\s+", " ", __import__("html").unescape(value)))
                continue
            if what == "open":
                path.append(html._step(value, attributes))
                quiet += value in html.NOISE
                hit = value in html.CONTAINERS and ">".join(path) == wanted
                deep, found = deep + hit, found or hit
            else:
                deep -= value in html.CONTAINERS and ">".join(path) == wanted
                path.pop()
                quiet -= value in html.NOISE
            if value in html.BLOCKS:
                out.append("\n")
        return "\n".join(y for x in "".join(out).split("\n") if (y := re.sub(" +", " ", x).strip())) if found else None

    want = {}
    for r in pages:
        h, own = host[r.page_id], best[r.page_id]
        text_ = inside(r.html, won[h]) if h in won else None
        if text_:
            want[r.page_id] = (h, won[h], True, text_)
        elif own and (t := inside(r.html, own[0])):
            want[r.page_id] = (h, own[0], False, t)
    got = {r.page_id: (r.host, r.path, r.consensus, r.text) for r in queries.op3_html_extraction(spark, sf_dir).collect()}
    assert got == want and any(v[2] for v in want.values())


def test_packing_tree_against_brute_force(spark, docs, monkeypatch):
    """Each round and merge by hand: the bins' fills are those of best-fit within partitions, then over what was left of each."""
    sizes = {i: n for i, n in enumerate(random.Random(8).choices(range(1, 60), k=300))}
    table = spark.createDataFrame([(i, "w " * n) for i, n in sizes.items()], "doc_id long, text string").repartition(5, "doc_id")
    parts = collections.defaultdict(list)
    for r in table.withColumn("p", F.spark_partition_id()).collect():
        parts[r.p].append(sizes[r.doc_id])

    def fit(items, capacity):
        rooms: list[int] = []
        for n in sorted(items, reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        return [capacity - x for x in rooms]

    full, rest = [], []
    for items in parts.values():
        for x in fit(items, 64):
            (full if x >= 0.98 * 64 else rest).append(x)
    got = packing.pack(table, capacity=64, fan_in=8).collect()
    assert sorted(r.fill for r in got) == sorted(full + fit(rest, 64))
    assert sorted(i for r in got for i in r.doc_ids) == sorted(sizes)
    many = packing.pack(table, capacity=64, fan_in=2).collect()
    assert sorted(i for r in many for i in r.doc_ids) == sorted(sizes) and len(many) <= sum(sizes.values()) / 64 * 1.05 + 1


def test_packing(docs, empty, monkeypatch):
    got = packing.pack(docs.repartition(5), capacity=64, fan_in=2).collect()
    assert len({r.bin for r in got}) == len(got)
    places = collections.defaultdict(list)
    for r in got:
        assert r.fill == sum(r.lengths) <= 64
        for i, s, n in zip(r.doc_ids, r.starts, r.lengths):
            places[i].append((s, n))
    piece = re.compile(packing.PIECE.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    want = collections.Counter()
    for i, t, _ in RAW:
        if i is not None and t:
            want[i] += len(piece.findall(t))
    assert {i: sum(n for _, n in v) for i, v in places.items()} == {k: v for k, v in want.items() if v}
    at = 0
    for s, n in sorted(places[9]):
        assert s == at
        at += n
    assert len(got) <= sum(want.values()) / 64 * 1.02 + 2
    assert packing.pack(empty).isEmpty()


def test_licenses(docs, empty):
    assert [(r.doc_id, r.license, r.dice) for r in licenses.scan(docs).collect()] == [(12, "MIT", 1.0)]
    assert licenses.scan(empty).isEmpty()


def test_licenses_that_differ_by_a_word_are_told_apart(spark):
    names = {"GPL-3.0": "GNU General Public License, version 3", "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3", "GPL-2.0": "GNU General Public License, version 2"}
    data = [(f"Licensed under the {t}.", {k}) for k, t in names.items()]
    data += [(dict(reversed(licenses.TEMPLATES))[k] if k != "LGPL-3.0" else licenses._LGPL3, {k}) for k in ("CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-2.0")]
    data += [(licenses._BSD3 + licenses._BSD_END, {"BSD-3-Clause", "BSD-2-Clause"}), (licenses._BSD2 + licenses._BSD_END, {"BSD-2-Clause"}), ("// SPDX-License-Identifier: LGPL-2.1-or-later", {"LGPL-2.1"})]
    data += [(f"Licensed under the {names['GPL-3.0']}.\n\n{text(4, 40)}\n\nLicensed under the {names['LGPL-3.0']}.", {"GPL-3.0", "LGPL-3.0"})]
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert [got[i] for i in range(len(data))] == [k for _, k in data]


def test_licenses_inside_long_texts(spark):
    grant, mit, end = licenses._MIT.replace("following conditions: ", "following conditions:@").replace("of the Software. THE", "of the Software.@THE").split("@")
    gpl = licenses._GPL.replace("version. This", "version.@This").split("@")
    lines = lambda t: re.sub(r"(.{50}\S*) ", r"\1\n# ", t)
    long = text(98, 3000)
    data = [
        (1, f"{long}\n\n{grant}\n\n{mit}\n\n{end}\n\n{long}", "MIT"),
        (2, f"# {lines(gpl[0])}\n#\n# {lines(gpl[1])}\n\n{long}", "GPL-3.0"),
        (3, f"{long} Released under the MIT License. See the file for details. {long}", "MIT"),
        (4, f"{long}\n{long}", None),
    ]
    got = {(r.doc_id, r.license, r.dice) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string, k string")).collect()}
    assert got == {(i, k, 1.0) for i, _, k in data if k}


def test_licenses_as_published(spark):
    """Each whole grant or header with its blank lines, under a copyright line: its own template alone must find all of it."""
    grants = [(k, t) for k, t in licenses.TEMPLATES if len(t) > 200]
    bsd = [t for k, t in grants if k.startswith("BSD") and "AS IS" in t]
    assert len(bsd) == 2
    broken = [(k, re.sub(r" (?=\d\. |THIS SOFTWARE|THE SOFTWARE|IN NO EVENT|The above|This program is distributed|Unless|If a copy)", "\n\n", t)) for k, t in grants]
    data = [(i, f"Copyright (c) 2020, A. Holder\n\n{t}\n") for i, (_, t) in enumerate(broken)]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i, k] == 1.0 for i, (k, _) in enumerate(grants))
    whole = lambda t: {tuple(w[i : i + 2]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 1)}
    for name, start in (("BSD-2-Clause", licenses._BSD2), ("BSD-3-Clause", licenses._BSD3)):
        text_ = whole(f"Copyright (c) 2020, A. Holder\nAll rights reserved.\n\n{start}\n\n" + licenses._BSD_END)
        best = max(2 * len(text_ & whole(t)) / (len(text_) + len(whole(t))) for k, t in licenses.TEMPLATES if k == name)
        assert best > 0.9


def quality_stops(t: str) -> tuple:
    n = len(t.split())
    ratio = sum(w in quality.STOP_WORDS for w in t.split()) / n
    return ("stop_words" if n >= quality.STOP_FROM and ratio < 0.02 else "", pytest.approx(ratio))


def test_quality_stop_words_of_short_texts(spark):
    """The ratio is what it says; only the rule leaves short texts alone."""
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame([(1, "fish chips bird"), (2, "fish bird " * 30), (3, "fish bird " * 24 + "the"), (4, "THE der Más, fish")], "doc_id long, text string"), rules=[r for r in quality.RULES if r[0] == "stop_words"]).collect()}
    assert [(got[k].stop_word_ratio, got[k].keep) for k in (1, 2, 3, 4)] == [(0, True), (0, False), (1 / 49, True), (0.75, True)]


@pytest.mark.parametrize("junk", ["7" * 1_000_000, "7 " * 500_000, "A" * 1_000_000 + "a", "A1" * 500_000 + "a ", "..." * 333_000, " " * 1_000_000, "\n \t" * 333_000, "the " * 250_000, "- " * 500_000, "é" * 500_000], ids=range(10))
def test_quality_of_long_junk_is_quick(spark, junk):
    began = time.perf_counter()
    quality.assess(spark.createDataFrame([(1, junk)], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 10


def test_quality(spark, docs, empty):
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert got[4].broken.startswith("too_short") and got[5].broken == got[6].broken == got[4].broken
    w = text(1, 80).split()
    assert got[1].n_words == 80 and got[1].distinct_word_ratio == pytest.approx(len(set(w)) / 80) and got[1].mean_word_length == pytest.approx(sum(map(len, w)) / 80)
    assert (got[1].broken, got[1].stop_word_ratio) == quality_stops(text(1, 80)) and (got[9].broken, got[9].stop_word_ratio) == quality_stops(LONG)
    assert quality.assess(docs).count() == len(RAW) and quality.assess(empty).isEmpty()
    kept = quality.kept(docs.withColumn("m", F.lit(1)))
    assert kept.columns == [*docs.columns, "m"]
    verdicts = collections.Counter(r.doc_id for r in quality.assess(docs).where("keep").collect())
    assert verdicts == collections.Counter(r.doc_id for r in kept.collect())
    edge = spark.createDataFrame([(1, "aa bb the cc")], "doc_id long, text string")
    assert quality.assess(edge, rules=(("short", "n_words", 4, 4, 0),)).first().keep
    assert "Python" not in quality.assess(docs)._jdf.queryExecution().toString()


def test_pii_query_against_brute_force(spark, sf_dir):
    """All spans found text by text, reliabilities estimated from votes counted in a loop, the classifier fitted here on all of them."""
    import numpy as np

    rows_ = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for a, z, kind in pii.spans(r.text):
            near = (r.text[a:z], kind, r.text[max(0, a - pii.NEAR) : a], r.text[z : z + pii.NEAR])
            rows_.append((r.doc_id, a, z - a, kind, pii.votes(*near), pii.traits(*near)))
    kind, vote = np.array([pii.KINDS.index(r[3]) for r in rows_]), np.array([r[4] for r in rows_])
    p = 1 / (1 + np.exp(-1.5 * vote.sum(1)))
    for _ in range(50):  # each span for itself, not each pattern of votes
        share, odds = {}, {}
        for k in set(kind.tolist()):
            at = kind == k
            share[k] = (p[at].sum() + 1) / (at.sum() + 2)
            for j in range(vote.shape[1]):
                for v, (no, yes) in zip((-1, 0, 1), ((3, 1), (2, 2), (1, 3))):
                    odds[k, j, v] = (yes + p[at & (vote[:, j] == v)].sum()) / (6 + p[at].sum()), (no + (1 - p)[at & (vote[:, j] == v)].sum()) / (6 + (1 - p)[at].sum())
        new = np.array([math.log(share[k] / (1 - share[k])) + sum(math.log(odds[k, j, v][0] / odds[k, j, v][1]) for j, v in enumerate(x)) for k, x in zip(kind.tolist(), vote.tolist())])
        last, p = p, 1 / (1 + np.exp(-np.clip(new, -35, 35)))
        if np.abs(p - last).max() < 1e-6:
            break
    x = np.array([r[5] for r in rows_])
    model = pii.fit_dense(x, p)
    q = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ model)))
    want = {r[:3]: (r[3], v) for r, v in zip(rows_, q) if v >= pii.THRESHOLD}
    got = {(r.doc_id, r.start, r.n_chars): (r.kind, r.probability) for r in queries.op6_pii(spark, sf_dir).collect()}
    sure = {k for k, v in zip((r[:3] for r in rows_), q) if abs(v - pii.THRESHOLD) > 0.02}
    assert {k for k in got if k in sure} == {k for k in want if k in sure} and len(want) > 20
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=0.02) for k in want if k in sure)


def test_pii_of_repeated_rows_and_ties(spark):
    t = "write to jo@example.com or jo@example.com now"
    got = rows(pii.detect(spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (3, "")], "doc_id long, text string")))
    assert [r[:4] for r in got] == sorted([(i, s, 14, "email") for i in (1, 1, None) for s in (9, 27)], key=str)


def test_pii(docs, empty):
    assert [(r.doc_id, r.kind, r.n_chars) for r in pii.detect(docs).collect() if r.kind == "email"] == [(11, "email", 20)]
    assert pii.detect(empty).isEmpty() and pii.detect(docs.where("doc_id = 7")).isEmpty()


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (9, None, 1), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    out = toxicity.classify(docs, chain)
    assert out.count() == len(RAW) and out.columns == ["doc_id", "p_low_quality", "p_toxic", "p_toxic_prose", "is_low_quality", "is_toxic", "is_toxic_prose"]
    assert out.where("doc_id IN (4, 5, 6) AND (is_toxic OR p_toxic > 0)").isEmpty()
    assert toxicity.classify(empty, chain).isEmpty() and toxicity.fit(empty, labels.limit(0)).names == chain.names


def test_toxicity_on_held_out_documents(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(d, lab.where("doc_id % 3 > 0"))
    held = toxicity.classify(d, chain).join(lab.where("doc_id % 3 = 0"), "doc_id")
    n = {(r.toxic, r.is_toxic): r["count"] for r in held.groupBy("toxic", "is_toxic").count().collect()}
    hit, missed, wrong = (n.get(k, 0) for k in ((1, True), (1, False), (0, True)))
    always = 2 * (hit + missed) / (2 * (hit + missed) + sum(n.values()) - hit - missed)  # F1 of calling every text toxic; that of none is 0
    assert 2 * hit / (2 * hit + missed + wrong) > always + 0.3


def test_toxicity_on_tasks_is_the_same_as_here(spark, sf_dir, monkeypatch):
    """The query's result beside one with every fit made in this process, and each probability by hand."""
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    tasks = toxicity.fit(d, lab)
    monkeypatch.setattr(toxicity, "_on_tasks", lambda spark, x, width: None)
    here = toxicity.fit(d, lab)
    assert all((a == b).all() for k in ("sparse", "dense") for a, b in zip(getattr(tasks, k), getattr(here, k))) and tasks.thresholds == here.thresholds
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    for r in d.where("doc_id % 40 = 0").collect():
        earlier: list[float] = []
        (_, _, x), *_ = toxicity.features(__import__("pyarrow").array([r.text]))
        for k, name in enumerate(here.names):
            dense = [*x.dense[0], *(2 * p - 1 for p in earlier)]
            z = sum(float(here.sparse[k][i]) * v for i, v in zip(x.index, x.value)) + sum(a * b for a, b in zip(dense, here.dense[k]))
            earlier.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
            has = bool(WORD.search(r.text))
            assert got[r.doc_id][f"p_{name}"] == pytest.approx(earlier[-1] * has, abs=2e-6)
            assert got[r.doc_id][f"is_{name}"] == (has and got[r.doc_id][f"p_{name}"] >= here.thresholds[k]) or abs(earlier[-1] - here.thresholds[k]) < 1e-5


def test_toxicity_query_gives_every_document(spark, sf_dir):
    got = queries.op7_toxicity(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert not got.where("is_low_quality AND NOT is_toxic").isEmpty()


def test_html(spark):
    page = "<html><body><div class='a'><p>{}</div><article><p>{}</article></body></html>"
    data = [(k, "https://www.Host.com/x", page.format("ad", text(k, 12)), "a", "b") for k in range(4)]
    data += [(9, "http://host.com", page.format(text(9, 9), "few"), "a", "b"), (10, None, page.format("ad", text(1, 9)), "", ""), (11, "u", None, "", ""), (12, "http://one.org/", "", "", ""), (None, "http://two.org/", page.format("x", text(2, 9)), "", ""), (1, "https://host.com", page.format("ad", text(1, 12)), "a", "b")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(data, EMPTY_PAGES)).collect()}
    assert set(got) == {0, 1, 2, 3, 9, 10, None}
    assert got[9].path == "html>body>article" and got[9].text == "few" and got[9].consensus
    assert not got[10].consensus and got[10].host is None and not got[None].consensus
    assert html.extract(spark.createDataFrame([], EMPTY_PAGES)).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k != "pipeline") == list(range(1, 11))


def test_pipeline_against_brute_force(spark, sf_dir):
    """The stages on small documents, with the language stage's and the secret scan's decisions taken from their own rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    langs = {r.doc_id for r in language.identify(docs, language.fit(docs)).where("keep").collect()}
    left = [(i, t) for i, t in table if i in langs]
    part = {i: i for i, _ in left}
    for a, b in sorted(similar(left)):
        a, b = part[a], part[b]
        part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    left = [(i, t) for i, t in left if part[i] == i]
    need = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)} | {tuple(w) for w in items if 5 <= len(w) < 13}
    sizes = {len(x) for x in need}

    def clean(t):
        w = WORD.findall(t.lower())
        return not any(tuple(w[k : k + n]) in need for n in sizes for k in range(len(w) - n + 1))

    left = [(i, t) for i, t in left if clean(t)]
    piece = re.compile(packing.PIECE.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    want = {i: len(piece.findall(re.sub(r"\b[0-9a-f]{40}\b", secrets.MARK, t))) for i, t in left}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        for i, n in zip(r.doc_ids, r.lengths):
            got[i] += n
    assert got == want


def test_stages_keep_columns(spark, docs, sf_dir):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes, name


def test_stages_of_an_empty_table_and_of_nulls(spark, docs, empty, sf_dir):
    nulls = docs.where("doc_id = 1").select(*[F.lit(None).cast(kind).alias(c) for c, kind in docs.dtypes])
    left = {"language_id": 0, "near_duplicates": 2, "decontamination": 2, "secret_scan": 2, "best_fit_packing": 0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).isEmpty(), name
        assert stage(spark, nulls, sf_dir).count() == left[name], name


def test_pipeline_leaves_only_its_bins(spark, sf_dir):
    import os

    folder = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0
