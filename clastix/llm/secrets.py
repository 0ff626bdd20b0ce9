"""Secrets in texts: patterns propose candidates, a random forest removes the false positives.

The forest looks at a candidate's length, its character transitions, how much of it dictionary words
cover, the path it comes from and the words next to it. It is trained from labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as St

from .forest import Forest, grow
from .scratch import bounded

THRESHOLD = 0.5
MARK = "<secret>"
#: Characters before and after a candidate in which neighbouring words are looked for.
NEAR = 48

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_TELLING = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|credential"
_ASSIGNED = re.compile(rf"(?i)(?:{_TELLING})s?[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]+)")
_PREFIX = r"AKIA|ASIA|gh[pousr]_|glpat-|xox[abpr]-|sk[-_]|AIza|eyJ|npm_|pypi-"
#: What lies behind belongs to the next finding.
_NEXT = re.compile(rf"[\n,;]|(?i:{_TELLING})s?[\"']?\s*[=:]")
#: What every text with a candidate has, in RE2: a run needs a digit or a known prefix, an assigned value a telling name.
_HINT = rf"[0-9]|{_PREFIX}|(?i:{_TELLING})"
_KNOWN = re.compile(_PREFIX)
_GOOD = re.compile(r"(?i)token|secret|passw|pwd|passphrase|api.?key|auth|bearer|credential|private|access.?key")
_BAD = re.compile(r"(?i)commit|sha-?\d|md5|checksum|digest|revision|uuid|guid|hash|etag|example|sample|version|integrity|image|order|invoice|build|isbn|doi")
_TEST = re.compile(r"(?i)test|spec|example|fixture|mock|lock|docs?/|readme")
_CONFIG = re.compile(r"(?i)\.env|config|settings|secret|deploy|\.ya?ml|\.ini|\.properties|\.tf")
_WORDS = """about access account action active address admin after all and api app application archive array assets async auth
back base batch before begin billing binary block body boolean branch browser buffer build business button bytes cache call
camel cancel case change character check child class clean click client close cloud code collection color column command
common component config connection console const constructor container content context control convert cookie copy core
count create current custom daily data database date debug default delete description design dest detail device dialog
directory disable display document domain done double download driver edit editor element email empty enable encode end
engine entry enum environment error event example exception execute exist export express factory false feature field file
filter final find first flag float folder font footer form format forward found frame from function game general generate
get global graph group handle handler has header health height hello help here hidden history home host html icon image
implement import index info init inner input insert install instance integer interface internal invalid is item java job
join json key label language last layout left length level library license limit line link list listener load local lock
log login long machine mail main manager map mark match max media member memory menu message meta method middle migration
min mobile mock mode model module money monitor mouse move multi name native network new next node normal not note null
number object observer offset online open operation option order org other output override owner package page parameter
parent parse part password path pattern payment pending people permission phone picture pixel place platform player plugin
point policy pool position post prefix preview price private process product profile program project promise property
protocol provider proxy public publish purchase push quality query queue random range read ready record redirect reference
region register release remote remove render replace report repository request required reset resource response result
return right role root route row rule run sample save schema scope screen script scroll search second section security
select self send sequence server service session set setting setup share show side simple single site size snapshot socket
some sort source special spring start state static status step stop storage store stream string style submit success
summary support switch sync system table tag target task team template test text the theme thread time timeout title token
tool total track transaction transform translate tree trigger true type undefined unique unit unknown update upload url
user username util valid validate value variable vector vendor version video view visible wait watch web width window with
word work world write wrong your zone here change placeholder dummy foobar xxxx"""
_DICTIONARY = frozenset(_WORDS.split())
_LONGEST = max(map(len, _DICTIONARY))


def coverage(s: str) -> float:
    """The share of s that dictionary words of three letters or more cover, taken greedily, the longest first at each place."""
    low, i, got = s.lower(), 0, 0
    while i < len(low):
        for k in range(min(_LONGEST, len(low) - i), 2, -1):
            if low[i : i + k] in _DICTIONARY:
                got += k
                i += k
                break
        else:
            i += 1
    return got / max(1, len(s))


def _kinds(s: str) -> str:
    return "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in s)


def features(s: str, before: str, after: str, path: str | None) -> list[float]:
    k = _kinds(s)
    n = len(s)
    near, behind = before[-NEAR:], _NEXT.split(after[:NEAR], maxsplit=1)[0]
    path = path or ""
    return [
        min(n, 200),
        sum(a != b for a, b in zip(k, k[1:])) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in Counter(s).values()),
        coverage(s),
        k.count("0") / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(bool(_KNOWN.match(s))),
        float(len(_GOOD.findall(near))),
        float(len(_BAD.findall(near))),
        float(len(_GOOD.findall(behind))),
        float(len(_BAD.findall(behind))),
        float(bool(re.search(r"[=:]\s*[\"']?$", near))),
        float(near.endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(bool(_TEST.search(path))),
        float(bool(_CONFIG.search(path))),
        len(set(s)) / n,
        k.count("-") / n,
        float(bool(re.search(r"(?i)x{4,}|your|here|change|placeholder|dummy|\*{3,}|\.{3,}", s))),
    ]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, is a secret): findings as reviewers label them, of the usual kinds, made from a seed."""
    rng = np.random.default_rng(seed)
    hexa, alnum, upper, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"
    word = sorted(_DICTIONARY)
    of = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    pick = lambda a: a[int(rng.integers(0, len(a)))]
    some = lambda k: " ".join(pick(word) for _ in range(k))
    out = []
    for _ in range(n):
        quote = pick(['"', '"', "'", ""])
        path = pick(["src/app.py", "config/settings.yml", ".env", "docs/readme.md", "lib/client.js", "tests/fixtures/a.json", "", "deploy/main.tf", "package-lock.json", "notes.txt"])
        if rng.random() < 0.5:
            s = pick([lambda: of(hexa, pick([32, 40, 40, 64])), lambda: of(alnum, pick([20, 24, 32, 40, 48])), lambda: "AKIA" + of(upper, 16), lambda: "ghp_" + of(alnum, 36), lambda: "sk-" + of(alnum, 40), lambda: "eyJ" + of(alnum + "-_", 60), lambda: of(alnum + "+/", 40), lambda: of(alnum + "!#$%", pick([9, 12, 16]))])()
            key = pick(["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "private key", "credential", "bearer", "Authorization"])
            glue = pick([" = ", "=", ": ", " : ", " ", " => "]) if not _KNOWN.match(s) or rng.random() < 0.8 else " "
            before = f"{some(3)} {key if rng.random() < 0.95 or not _KNOWN.match(s) else ''}{glue}{quote}"
            out.append((s, before, quote + " " + some(2), path, 1))
        else:
            kind = int(rng.integers(0, 10))
            s, before = [
                lambda: (of(hexa, 40), f"{some(2)} commit "),
                lambda: ("-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), f"{some(2)} {pick(['uuid', 'id', 'guid', 'request'])}{pick([' ', ': ', ' = '])}"),
                lambda: (of(hexa, pick([32, 40, 64])), f"{some(2)} {pick(['md5', 'sha256', 'checksum', 'digest', 'integrity', 'hash', 'etag'])}{pick([' ', ': ', ' = '])}"),
                lambda: ("_".join(pick(word) for _ in range(4)) + of(digit, 2), f"{some(3)} "),
                lambda: ("".join(pick(word).title() for _ in range(4)) + of(digit, 1), f"{some(2)} {pick(['token = ', 'key: ', ' ', ' '])}"),
                lambda: (pick(["YOUR_API_KEY_HERE1", "xxxxxxxxxxxxxxxx1", "changeme_placeholder0", "insert-your-token-here-1", "dummy_secret_value_123"]), f"{some(2)} {pick(['token', 'secret', 'api_key', 'password'])} = {quote}"),
                lambda: ("/".join(pick(word) for _ in range(4)) + "/" + of(digit, 3), f"{some(2)} "),
                lambda: (of(digit, pick([16, 18, 20])), f"{some(4)} "),
                lambda: (f"{of(digit, 4)}-{of(digit, 2)}-{of(digit, 2)}T{of(digit, 6)}Z-{pick(word)}", f"{some(2)} version "),
                lambda: (of(hexa, pick([24, 40])), f"{some(3)} revision {quote}"),
            ][kind]()
            out.append((s, before, pick([" ", quote + " "]) + some(2), path, 0))
    lower, more = "abcdefghijklmnopqrstuvwxyz", []
    for _ in range(n // 4):  # values of letters only or few characters, and findings that the words behind them decide
        quote = pick(['"', "'", ""])
        key = pick(["token", "secret", "api_key", "password", "passwd", "pwd", "credential", "passphrase"])
        before, path = f"{some(3)} {key}{pick([' = ', '=', ': '])}{quote}", pick(["src/app.py", "config/settings.yml", ".env", "", "lib/client.js", "notes.txt"])
        s, after, y = [
            lambda: ("".join(pick(word) for _ in range(3)), quote + " " + some(2), 1),
            lambda: (of(lower, pick([8, 10, 14, 20])), quote + " " + some(2), 1),
            lambda: (of(lower + lower.upper(), pick([8, 12, 20])), quote + " " + some(2), 1),
            lambda: (of(lower + digit + "!#$%", pick([4, 5])) + pick(digit), quote + " " + some(2), 1),
            lambda: (pick(word), pick([" ", quote + " "]) + some(2), 0),
            lambda: (pick(["None", "null", "true", "false", "str", "string", "None)", "self", "required", "optional", "***", "x", "{}", "...", "1", "int", "env"]), pick([" ", quote + " "]) + some(2), 0),
            lambda: (pick(word) + pick([".", "_", ""]) + pick(word).title() + pick(["", "()", "(self)"]), " " + some(2), 0),
            lambda: (pick(word) + pick([".", "_", "["]) + pick(word) + pick(["", "()", "]"]), " " + some(2), 0),
        ][int(rng.integers(0, 8))]()
        more.append((s, before, after, path, y))
        s = pick([lambda: of(hexa, 40), lambda: of(alnum, 32)])()
        if y:
            more.append((s, f"{some(3)} ", f" is the {key} {some(1)}", path, 1))
        else:
            more.append((s, f"{some(3)} ", f" is the {pick(['commit', 'checksum', 'md5', 'digest', 'revision', 'hash'])} {some(1)}", path, 0))
    return out + more


def train(findings: list[tuple[str, str, str, str, int]] | None = None, seed: int = 0) -> Forest:
    """A forest from labelled findings (candidate, text before, text after, path, 0 or 1); by default labelled_findings()."""
    rows = labelled_findings() if findings is None else findings
    return grow(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]), seed=seed)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets, in order, without overlap: long runs with a letter and a digit or a known prefix, and values assigned to telling names."""
    spans = []
    for m in _RUN.finditer(text):
        s = m[0]
        if _KNOWN.match(s) or any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            spans.append(m.span())
    spans += [m.span(1) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def find(text: pa.Array, paths: list[str | None], forest: Forest, threshold: float) -> list[tuple[int, int, int, float]]:
    """(row, start, end, probability) of the secrets in a batch of texts, starts in characters."""
    hint = pc.fill_null(pc.match_substring_regex(text, _HINT), False).to_numpy(zero_copy_only=False)
    at, rows = [], []
    for i in np.flatnonzero(hint).tolist():
        t = text[i].as_py()
        for a, b in candidates(t):
            at.append((i, a, b))
            rows.append(features(t[a:b], t[max(0, a - NEAR) : a], t[b : b + NEAR], paths[i]))
    if not rows:
        return []
    p = forest.predict(np.array(rows))
    return [(*x, float(q)) for x, q in zip(at, p) if q >= threshold]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, n_chars, digest, probability): each secret found; digest is the start of its SHA-256, not the secret.

    A null or empty text has no findings; a null path, or a path_col that docs lacks, is no path; a null id
    stays null. Repeated rows are each reported, several findings of a text in order; of overlapping candidates
    the one that starts first counts, of those the longest. An empty table gives no rows. Texts are read whole.
    """
    docs = bounded(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train() if forest is None else forest)
    kind = docs.schema[id_col].dataType.simpleString()
    has_path = path_col is not None and path_col in docs.columns
    columns = [id_col, text_col, *([path_col] if has_path else [])]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [None if x is None else str(x) for x in b.column(2).to_pylist()] if has_path else [None] * b.num_rows
            got = find(b.column(1), paths, sent.value, threshold)
            row = pa.array([g[0] for g in got], pa.int64())
            digest = [hashlib.sha256(b.column(1)[g[0]].as_py()[g[1] : g[2]].encode()).hexdigest()[:12] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] - g[1] for g in got], pa.int32()), pa.array(digest, pa.string()), pa.array([round(g[3], 6) for g in got], pa.float64())], names=["doc_id", "start", "n_chars", "digest", "probability"])

    return docs.select(*[docs[c] for c in columns]).mapInArrow(go, f"doc_id {kind}, start int, n_chars int, digest string, probability double")


def redacted(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars", forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each secret in the texts replaced by <secret>, and length_col, where there is one, set to the new length of those texts.

    All rows and columns stay, under their names and in their types: null and empty texts, rows with a null id
    and repeated rows as they are, the last each redacted. An empty table stays empty. A path_col or
    length_col that docs lacks is passed over. Texts are read whole.
    """
    docs = bounded(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train() if forest is None else forest)
    names = docs.columns
    at, path = names.index(text_col), names.index(path_col) if path_col in names else None
    size = names.index(length_col) if length_col in names else None

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [None if x is None else str(x) for x in b.column(path).to_pylist()] if path is not None else [None] * b.num_rows
            got = find(b.column(at), paths, sent.value, threshold)
            if got:
                text = b.column(at).to_pylist()
                columns = list(b.columns)
                lengths = columns[size].to_pylist() if size is not None else None
                for i, a, z, _ in reversed(got):
                    text[i] = text[i][:a] + MARK + text[i][z:]
                for i in {g[0] for g in got}:
                    if lengths is not None:
                        lengths[i] = len(text[i])
                columns[at] = pa.array(text, columns[at].type)
                if lengths is not None:
                    columns[size] = pa.array(lengths, columns[size].type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(go, St.StructType(docs.schema.fields))
