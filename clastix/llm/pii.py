"""Personal data by weak supervision.

Broad patterns propose spans. Labelers, by strict patterns, gazetteers, checksums and context words, vote
on each; expectation-maximisation over the counts of vote patterns estimates how reliable each is and so
how likely each pattern means personal data. On those likelihoods a classifier of spans is trained,
which sees the spans themselves, and decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_dense, sigmoid
from .scratch import bounded, row_key, written

KINDS = ("email", "phone", "ip", "card", "iban", "id_number", "address", "person")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "edges")
THRESHOLD = 0.5
#: Spans that the classifier is trained on, at most, about; those of the least hash.
SAMPLE = 20_000
NEAR = 40

#: Given names and places, as gazetteers.
GIVEN = frozenset(
    """Aaron Adam Adrian Agnes Alain Alan Albert Alejandro Alex Alexander Alfred Alice Alicia Amanda Amélie Amy Ana André Andrea Andreas Andrew Angela Anja Anke Ann
Anna Anne Antoine Antonio Arthur Barbara Beatriz Ben Benjamin Bernard Bernd Birgit Brandon Brian Bruno Camille Carla Carlos Carmen Carol Caroline Catherine Cecilia Charles
Charlotte Chloé Christian Christina Christine Christopher Claire Clara Claudia Cristina Cynthia Daniel Daniela David Deborah Denis Dennis Diana Diego Dieter Dominique Donald
Donna Dorothy Douglas Edward Elena Elisabeth Elizabeth Emily Emma Enrique Eric Esther Eva Fatima Felix Fernando Florian Frances Francis Francisco François Françoise Frank Franz
Frédéric Gabriel Gary George Gerhard Gloria Grace Gregory Guillaume Gérard Hans Harold Heather Heike Heinz Helen Helena Helga Henri Henry Hugo Ines Ingrid Irene Isabel
Isabella Jack Jacob Jacques Jaime James Jan Jane Janet Jason Javier Jean Jeffrey Jennifer Jeremy Jesse Jessica Joan Joanna Johannes John Jonas Jonathan Jorge Joseph Joshua José
Juan Juana Judith Julia Julie Julien Justin Jürgen Karen Karl Katherine Kathleen Kathrin Katja Kevin Klaus Kyle Larry Laura Laurent Lena Leon Leonard Lucas Lucie Lucía
Luis Luisa Lukas Manfred Manon Manuel Manuela Marcel Marco Marcus Margaret Marguerite Maria Marie Marina Mario Marion Mark Markus Marta Martha Martin Martina Mary Matthew
Matthias Mathieu María Max Maximilian Megan Melissa Michael Michel Michelle Miguel Monica Monika Monique Nancy Natalie Nathalie Nathan Nicholas Nicolas Nicole Nina Olga Oliver
Olivier Pablo Pamela Pascal Patricia Patrick Paul Paula Pedro Peter Petra Philip Philippe Pierre Pilar Rachel Rafael Ralf Ralph Ramón Raymond Rebecca Renate Richard
Robert Roger Ronald Rosa Ruth Ryan Sabine Samantha Samuel Sandra Sara Sarah Scott Sebastian Sergio Sharon Silvia Simon Sofia Sophie Stefan Stefanie Stephanie Stephen Steven
Susan Susanne Sylvie Teresa Theresa Thomas Thierry Timothy Tobias Tyler Ulrich Ursula Valérie Vera Veronica Victor Victoria Vincent Virginia Walter Werner William Wolfgang Yves Zoe
Élise Étienne Ángel Óscar""".split()
)
PLACES = frozenset(
    """Amsterdam Athens Atlanta Austin Baltimore Barcelona Basel Bergen Berlin Bern Bilbao Birmingham Bogotá Bonn Bordeaux Boston Bremen Bristol Brooklyn Bruxelles Brussels
Budapest Cambridge Cardiff Charlotte Chicago Cleveland Cologne Columbus Copenhagen Cork Dallas Denver Detroit Dortmund Dresden Dublin Düsseldorf Edinburgh Essen Florence
Frankfurt Genève Geneva Genoa Glasgow Graz Grenoble Hamburg Hannover Helsinki Houston Innsbruck Jacksonville Köln Lausanne Leeds Leipzig Lille Lima Lisbon Liverpool London Lyon
Madrid Málaga Manchester Marseille Melbourne Memphis Miami Milan Milwaukee Minneapolis Montpellier Montreal Munich München Nantes Naples Nashville Newark Nice Nottingham Nürnberg
Oakland Orlando Oslo Ottawa Oxford Paris Philadelphia Phoenix Pittsburgh Portland Porto Prague Quito Reims Rennes Richmond Rome Rotterdam Sacramento Salzburg Santiago Seattle
Sevilla Sheffield Stockholm Strasbourg Stuttgart Sydney Toledo Toronto Toulouse Tucson Turin Valencia Vancouver Venice Vienna Warsaw Washington Wien Wiesbaden Zaragoza Zurich Zürich
Argentina Australia Austria Belgium Brazil Canada Chile Colombia Denmark England España Finland France Germany Ireland Italy Mexico Netherlands Norway Peru Poland Portugal Scotland Spain Sweden Switzerland Wales Deutschland""".split()
)
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Mme|Madame|Monsieur"
#: What every text with a span has, in RE2: an at-sign, the digits of a number (seven at least, or an address's), the start of
#: an IBAN, a title or given name before a word, or the name of a street.
_HINT = (
    r"@|\p{Nd}[\p{Nd} \t().:\-]{5}|[A-Z]{2}\p{Nd}{2} ?[A-Z0-9]{4}"
    rf"|(?:{_TITLES})\.? [A-Z]|(?:{'|'.join(sorted(GIVEN))}) [A-Z]"
    r"|\p{Nd},? (?:[A-Z]|rue|avenue|boulevard|place|impasse)|(?:straße|strasse|weg|platz|allee|gasse) \p{Nd}|(?:Calle|Avenida|Plaza) "
)
_NAME = r"[A-Z][a-zß-öø-ÿ]+(?:[-'][A-Z][a-zß-öø-ÿ]+)?"
_PERSON = re.compile(rf"(?<!\w)(?:(?:{_TITLES})\.? (?:{_NAME} )?{_NAME}|(?:{'|'.join(sorted(GIVEN, key=lambda x: (-len(x), x)))})(?: [A-Z]\.)?(?: (?:(?:de|del|la|van|von|der) )*{_NAME}){{1,2}})(?!\w)")
_STREET = re.compile(
    rf"(?<![\w.])(?:\d{{1,5}} (?:[NSEW]\.? )?(?:{_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Square|Terrace|Way)(?!\w)\.?"
    rf"|\d{{1,4}},? (?:rue|avenue|boulevard|place|impasse) (?:(?:de|du|des|la|le) )*{_NAME}"
    rf"|{_NAME}(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}(?!\w)|(?:Calle|Avenida|Plaza) (?:(?:de|del|la|los) )*{_NAME},? \d{{1,4}}(?!\w))"
)
#: Numbers and blanks, signs between them, one after the other; where a number may start in it; one without blanks.
_RUN = re.compile(r"(?<![\w.])\+?\(?\d[\d \t().\-:]*\d(?![\w])")
_START = re.compile(r"(?<![\w.\-(+])\(?\d")
_PIECE = re.compile(r"\+?\(?\d[\d().\-]{5,28}\d(?![\w().\-]*\d)")
#: A longer number is none; the part of an address before the at-sign has 64 characters at most (RFC 5321).
_LONGEST = 64
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-\x80-\U0010ffff]{1,64}$"), re.compile(r"[A-Za-z0-9\-.\x80-\U0010ffff]{1,255}")
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "phone": re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "card": re.compile(r"\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}|3[47]\d{2}([ \-]?)\d{6}\2\d{5}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,38}"),
    "id_number": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "address": re.compile(r"\d{1,5},? \D{6,60}|\D{6,60} \d{1,4}"),
    "person": re.compile(rf"(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|{_NAME}(?: [A-Z]\.)?(?: (?:(?:de|del|la|van|von|der) )*{_NAME})+"),
}
_END = r"(?![\w]|[.\-]\d)"
_CARD, _ID = (re.compile(f"(?:{_STRICT[k].pattern}){_END}") for k in ("card", "id_number"))
_PHONE = re.compile(rf"(?:(?:1[ .\-])?{_STRICT['phone'].pattern}|(?:\+\d{{1,3}}[ .\-]?)?\(?\d{{1,2}}\)?(?:[ .\-]\d{{2}}){{4}}){_END}")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6")
#: Domains' ends, calling codes, issuers' digits and countries, as gazetteers.
_ENDS = frozenset("com org net edu gov mil int info biz io co app dev me eu de fr es it nl be at ch uk us ca au jp cn in br ru pl se no dk fi pt ie cz gr mx ar cl za kr tr ua hu ro".split())
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "61", "64", "81", "82", "86", "90", "91", "351", "353", "358", "380", "420")
_LANDS = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
_GOOD = {
    "email": r"mail|contact|write|reach|send|kontakt|correo|courriel|schreib",
    "phone": r"call|phone|tel|mobile|fax|ring|dial|sms|whatsapp|anruf|llam|appel",
    "ip": r"\bip\b|address|host|server|login|client|user|from",
    "card": r"card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte",
    "iban": r"iban|bank|account|konto|transfer|compte|cuenta",
    "id_number": r"ssn|social|security|identity|passport|tax",
    "address": r"address|live|lives|street|home|deliver|ship|wohn|adresse|dirección|habit|vive",
    "person": r"name|named|call|contact|dear|regards|sign|author|by |born|heiß|nom|llam|señor|herr|frau",
}
_GOOD = {k: re.compile(r"(?i)" + v) for k, v in _GOOD.items()}
_BAD = re.compile(r"(?i)version|release|build|isbn|issn|doi|order|invoice|ticket|article|serial|model|chapter|section|page|figure|score|date|total|sum\b|timestamp|unix|revision")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _number_kind(s: str) -> str | None:
    digits = sum(c.isdigit() for c in s)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s):
        return None
    if _STRICT["id_number"].fullmatch(s):
        return "id_number"
    if not s.startswith(("+", "(")) and 13 <= digits <= 19 and all(c.isdigit() or c in " -" for c in s):
        return "card"
    if 7 <= digits <= 15 and not re.search(r":|\.\.|--|  ", s):
        return "phone"
    return None


def _proposals(text: str, a: int, z: int) -> Iterator[tuple[float, int, str]]:
    """(weight, end, kind) of the numbers that may start at a: their digits, half of them if they have no kind's shape."""
    if _IP.match(text, a):
        return
    whole = [(m.end(), k) for p, k in ((_ID, "id_number"), (_CARD, "card"), (_PHONE, "phone")) if (m := p.match(text, a, z))]
    ends = {m.end()} if (m := _PIECE.match(text, a, z)) else set()
    broad = [(b, k) for b in sorted(ends | ({z} if z - a <= _LONGEST else set())) if (k := _number_kind(text[a:b])) and (b, k) not in whole]
    for n, (b, k) in enumerate(whole + broad):
        digits = re.sub(r"\D", "", text[a:b])
        if k == "card" and n < len(whole) and luhn(digits) and _ISSUER.match(digits):
            yield len(digits) + 2.0, b, k
        else:
            yield len(digits) * (1.0 if n < len(whole) else 0.5) + (n < len(whole) and k != "phone") * 0.5, b, k


def _numbers(text: str, a: int, z: int) -> list[tuple[int, int, str]]:
    """The numbers of a run, as the proposals without overlap that weigh most."""
    start = [a, *(m.start() for m in _START.finditer(text, a + 1, z))]
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] * (len(start) + 1)  # weight from here on, end, kind
    for i in range(len(start) - 1, -1, -1):
        best[i] = (best[i + 1][0], 0, None)
        for w, b, k in _proposals(text, start[i], z):
            w += best[bisect_left(start, b)][0]
            if w > best[i][0]:
                best[i] = (w, b, k)
    out, i = [], 0
    while i < len(start):
        _, b, k = best[i]
        if k:
            out.append((start[i], b, k))
        i = bisect_left(start, b) if k else i + 1
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all that may be personal data, in order, without overlap."""
    out: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        a, b = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if a and b:
            left = a[0].lstrip(".-'#$%&*!/=?^`{|}~")
            right = b[0].rstrip(".-")
            right = right[: (re.match(r"[A-Za-z0-9\-.]*", right).end())].rstrip(".-")
            if left and "." in right:
                out.append((at - len(left), at + 1 + len(right), "email"))
        at = text.find("@", at + 1)
    out += [(*m.span(), "ip") for m in _IP.finditer(text)]
    out += [(*m.span(), "iban") for m in _IBAN.finditer(text) if any(c.isdigit() for c in m[0][4:])]
    out += [(*m.span(), "address") for m in _STREET.finditer(text)]
    out += [(*m.span(), "person") for m in _PERSON.finditer(text)]
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7:
            out += _numbers(text, *m.span())
    out.sort(key=lambda x: (x[0], -x[1], KINDS.index(x[2])))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def votes(s: str, kind: str, before: str, after: str) -> list[int]:
    """1, -1 or 0 (no opinion) of each of LABELERS."""
    digits = re.sub(r"\D", "", s)
    pattern = 1 if _STRICT[kind].fullmatch(s) else -1
    checksum = gazetteer = 0
    if kind == "card":
        checksum = 1 if luhn(digits) else 0
        gazetteer = 1 if _ISSUER.match(digits) and len(digits) in (15, 16) else 0
    elif kind == "iban":
        checksum = 1 if _iban(s) else -1
        gazetteer = 1 if s[:2] in _LANDS else -1
    elif kind == "email":
        gazetteer = 1 if s.rpartition(".")[2].lower() in _ENDS else 0
    elif kind == "phone":
        if s.startswith("+"):
            gazetteer = 1 if digits.startswith(_CODES) else -1
        elif re.search(r"[()\- .]", s) is None:
            gazetteer = -1
    elif kind == "person":
        words = re.sub(rf"^(?:{_TITLES})\.? ", "", s).split()
        gazetteer = -1 if words[-1] in PLACES else 1 if words[0] in GIVEN else 0
    elif kind == "address":
        gazetteer = 1 if any(w in PLACES for w in re.findall(_NAME, s + after)) else 0
    elif kind == "ip":
        gazetteer = -1 if re.match(r"(0|127|255)\.|\d+\.\d+\.\d+\.0$", s) else 1
    near = before[-NEAR:]
    context = -1 if _BAD.search(near[-20:]) else 1 if _GOOD[kind].search(near) else 0
    edges = -1 if re.search(r"[\w=/$€#]$", before) or re.match(r"[\w=/%€]", after) else 0 if before[-1:].isspace() or not before else 0
    return [pattern, checksum, gazetteer, context, edges]


def traits(s: str, kind: str, before: str, after: str) -> list[float]:
    """What the classifier sees of a span."""
    n = len(s)
    return [
        *(float(kind == k) for k in KINDS),
        n / 20,
        sum(c.isdigit() for c in s) / n,
        sum(c.isalpha() for c in s) / n,
        sum(c in " .-()" for c in s) / n,
        float(s.startswith("+")),
        float("(" in s),
        len(set(s)) / n,
        *(v * 1.0 for v in votes(s, kind, before, after)),
    ]


@dataclass(frozen=True)
class Reliability:
    """Of each kind: the share of personal data, and for each labeler and truth (no, yes) the odds of voting -1, 0, 1."""

    share: np.ndarray
    table: np.ndarray  # kinds, labelers, truth, votes

    def posterior(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        """The likelihood that each pattern of votes (-1, 0, 1 by labelers) means personal data."""
        log = np.log(np.stack([1 - self.share[kind], self.share[kind]], 1))
        for k in range(vote.shape[1]):
            log = log + np.log(self.table[kind, k, :, vote[:, k] + 1])
        return sigmoid(log[:, 1] - log[:, 0])


def reliabilities(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> Reliability:
    """Expectation-maximisation over counted vote patterns, from the balance of the votes; the prior takes a labeler to be right rather than wrong."""
    k, m = len(KINDS), vote.shape[1]
    p = sigmoid(1.5 * vote.sum(1).astype(float))
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # truth by votes
    for _ in range(rounds):
        w = np.stack([count * (1 - p), count * p], 1)
        share = np.array([(w[kind == i, 1].sum() + 1) / (w[kind == i].sum() + 2) for i in range(k)])
        table = np.empty((k, m, 2, 3))
        for i in range(k):
            at = kind == i
            for j in range(m):
                for v in range(3):
                    table[i, j, :, v] = w[at & (vote[:, j] == v - 1)].sum(0) + prior[:, v]
        table /= table.sum(3, keepdims=True)
        new = Reliability(share, table).posterior(kind, vote)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return Reliability(share, table)


_SPANS = "doc_id {}, start int, n_chars int, kind int, vote array<int>, trait array<double>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, n_chars, kind, vote, trait) for all spans that may be personal data."""
    docs = bounded(docs)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            hint = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(text, _HINT), False)).to_pylist()
            rows = []
            for i in hint:
                t = text[i].as_py()
                for a, z, kind in spans(t):
                    near = (t[a:z], kind, t[max(0, a - NEAR) : a], t[z : z + NEAR])
                    rows.append((i, a, z - a, KINDS.index(kind), votes(*near), traits(*near)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "start", "n_chars", "kind", "vote", "trait"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(go, _SPANS.format(kind))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, n_chars, kind, probability): the spans that are personal data.

    The labelers' reliabilities come from the counts of all spans of docs; the classifier is fitted on
    about sample of them at most. A null or empty text has no spans, a null id stays null, repeated rows
    are each reported; an empty table, or one without spans, gives no rows. Texts are read whole.
    """
    found = written(candidates(docs, id_col, text_col), "spans")
    counted = found.groupBy("kind", "vote").count().toPandas()
    if not len(counted):
        return found.select("doc_id", "start", "n_chars", F.lit("").alias("kind"), F.lit(0.0).alias("probability")).where("false")
    counted = counted.sort_values("kind", kind="stable")
    kind, vote = counted["kind"].to_numpy(int), np.array([list(v) for v in counted["vote"]], int)
    truth = reliabilities(kind, vote, counted["count"].to_numpy(float))
    share = min(1.0, sample / counted["count"].sum())
    few = found.where(F.pmod(row_key("doc_id", "start", "kind"), F.lit(1 << 30)) < int(share * (1 << 30))).select("kind", "vote", "trait").toPandas()
    x = np.array([list(v) for v in few["trait"]], float).reshape(len(few), -1)
    y = truth.posterior(few["kind"].to_numpy(int), np.array([list(v) for v in few["vote"]], int).reshape(len(few), -1))
    order = np.lexsort((*x.T, y))
    model = fit_dense(x[order], y[order]) if len(few) else np.zeros(len(KINDS) + 8 + len(LABELERS))
    z = F.lit(float(model[-1]))
    for k, w in enumerate(model[:-1].tolist()):
        z = z + F.col("trait")[k] * F.lit(w)
    names = F.array(*[F.lit(k) for k in KINDS])
    p = F.round(1 / (1 + F.exp(-z)), 6)
    return found.select("doc_id", "start", "n_chars", names[F.col("kind")].alias("kind"), p.alias("probability")).where(F.col("probability") >= threshold)
