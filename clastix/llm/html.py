"""Main texts of web pages, by paths of containers that the pages of a host agree on.

Each page's containers are scored; its best one votes, by its generalised path of tags and classes, for
how the host's pages are built. The votes are counted in Spark. Each page is then extracted again, by
its host's winning path.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded, sized, written

CONTAINERS = frozenset("article section main div td body blockquote dd".split())
NOISE = frozenset("script style noscript template head nav footer header aside form button select iframe svg figure menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div article section main ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote dl dt dd figure form hr br body nav header footer aside".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "li", "dt", "dd"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A host without so many votes for one path keeps to each page's own best.
LEAST_VOTES = 2

#: A tag whose attributes hold no <, which most are; the scanner of tags() reads all others.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/><\"']*+)(?=[\s/>])((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME_END = re.compile(r"[\s/>]")
_SIGN = re.compile(r"[>\"']")
_RAW = re.compile(r"(script|style)\b", re.I)
_RAW_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)"


def _step(tag: str, attributes: str) -> str:
    """A tag with its classes, digits generalised, in order of the alphabet."""
    if "class" not in attributes and "CLASS" not in attributes.upper():
        return tag
    m = _CLASS.search(attributes)
    names = sorted({re.sub(r"\d+", "#", c) for c in (m[1] or m[2] or m[3] or "").split()}) if m else []
    return ".".join([tag, *names])


class _Next:
    """The next place of a pattern at or after places that don't decrease: each stretch of the page is searched once. The page's length if there is none."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.low, self.at = page, pattern, 0, -1

    def __call__(self, i: int) -> int:
        if not self.low <= i <= self.at:
            m = self.pattern.search(self.page, i)
            self.low, self.at = i, m.start() if m else len(self.page)
        return self.at


_GREATER = re.compile(">")


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag in lower case, closing, attributes) of each tag; the tag is None for comments, scripts and the like.

    A < that begins none of these, or whose > is missing or in quotes that don't end, is text. Takes time in
    proportion to the page: the places after closing quotes from which no tag ends are remembered.
    """
    n = len(page)
    name_end, sign, greater = _Next(page, _NAME_END), _Next(page, _SIGN), _Next(page, _GREATER)
    last = {q: page.rfind(q) for q in "\"'"}
    dead: set[int] = set()
    i = page.find("<")
    while 0 <= i < n - 1:
        plain = _PLAIN.match(page, i)
        if plain and (tag := plain[2].lower()) not in _RAW_END:
            yield i, plain.end(), tag, plain[1] == "/", plain[3]
            i = page.find("<", plain.end())
            continue
        end, tag, closing, attributes = -1, None, False, ""
        c = page[i + 1]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", i):
            end = page.find("]]>", i + 9)
            end = n if end < 0 else end + 3
        elif c in "!?":
            end = greater(i + 2) + 1
        else:
            raw = _RAW.match(page, i + 1)
            if raw and greater(raw.end()) < n:
                m = _RAW_END[raw[1].lower()].search(page, greater(raw.end()) + 1)
                end = m.end() if m else n
            else:
                at = i + 1 + (c == "/")
                if at < n and ("a" <= page[at] <= "z" or "A" <= page[at] <= "Z"):
                    begin = name_end(at + 1)
                    k, seen = sign(begin), []
                    while k < n and page[k] != ">" and k < last[page[k]]:
                        k = page.index(page[k], k + 1) + 1
                        if k in dead:
                            k = n
                            break
                        seen.append(k)
                        m = _SIGN.search(page, k)
                        k = m.start() if m else n
                    if k < n and page[k] == ">":
                        end, tag, closing, attributes = k + 1, page[at:begin].lower(), c == "/", page[begin:k]
                    else:
                        dead.update(seen)
        if 0 < end <= n:
            yield i, end, tag, closing, attributes
            i = page.find("<", end)
        else:
            i = page.find("<", i + 1)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, ""), in nested order, whatever the page leaves open or closes twice."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of each open tag its places in the stack
    walls: list[int] = []  # places of open containers and lists
    at = 0

    def pop() -> tuple[str, str, str]:
        tag = stack.pop()
        places[tag].pop()
        if walls and walls[-1] == len(stack):
            walls.pop()
        return "close", tag, ""

    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            yield "text", page[at:start], ""
        at = end
        if tag is None:
            continue
        if closing:
            if places.get(tag):
                down = places[tag][-1]
                while len(stack) > down:
                    yield pop()
            continue
        ends = SAME.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        down = max((places[x][-1] for x in ends if places.get(x)), default=-1)
        if down >= 0 and down >= (walls[-1] if walls else 0):
            while len(stack) > down:
                yield pop()
        yield "open", tag, attributes
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            yield "close", tag, ""
        else:
            places.setdefault(tag, []).append(len(stack))
            if tag in CONTAINERS or tag in ("ul", "ol", "dl", "table"):
                walls.append(len(stack))
            stack.append(tag)
    if at < len(page):
        yield "text", page[at:], ""
    while stack:
        yield pop()


class Paths:
    """Paths of one page as nodes of a tree: a node is a path's last step below its parent. 0 is the empty path."""

    def __init__(self):
        self.parent, self.step, self.length = [0], [""], [0]
        self.known: dict[tuple[int, str], int] = {}
        self.steps: dict[tuple[str, str], str] = {}

    def below(self, node: int, tag: str, attributes: str) -> int:
        step = self.steps.get((tag, attributes))
        if step is None:
            step = self.steps[tag, attributes] = _step(tag, attributes)
        got = self.known.get((node, step))
        if got is None:
            got = self.known[node, step] = len(self.parent)
            self.parent.append(node)
            self.step.append(step)
            self.length.append(self.length[node] + (node > 0) + len(step))
        return got

    def name(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))


def scores(page: str) -> tuple[Paths, dict[int, float]]:
    """The score of each container's path: the characters of its own blocks outside links, and half of those of the containers in it, less what is in links."""
    out: dict[int, float] = {}
    paths = Paths()
    path = [0]
    quiet = link = 0
    boxes: list[list] = [[0, 0.0]]
    for what, value, attributes in events(page):
        if what == "text":
            if not quiet:
                n = len(_SPACE.sub(" ", value).strip())
                boxes[-1][1] += -n if link else n
        elif what == "open":
            path.append(paths.below(path[-1], value, attributes))
            quiet += value in NOISE
            link += value == "a"
            if value in CONTAINERS:
                boxes.append([path[-1], 0.0])
        else:
            path.pop()
            quiet -= value in NOISE
            link -= value == "a"
            if value in CONTAINERS:
                node, got = boxes.pop()
                out[node] = out.get(node, 0.0) + got
                boxes[-1][1] += max(0.0, got) / 2
    if boxes[0][1]:
        out[0] = boxes[0][1]
    return paths, out


def best(page: str) -> tuple[str, float] | None:
    """The path of the highest score above zero; of equal ones the longest, then the one that opens first in the page."""
    paths, got = scores(page)
    node = max((k for k, s in got.items() if s > 0), key=lambda k: (got[k], paths.length[k], -k), default=None)
    return None if node is None else (paths.name(node), got[node])


def path_key(path: str) -> int:
    """A 64-bit key of a path, for sending it in place of the path."""
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_of(page: str, wanted: int) -> tuple[str, str] | None:
    """(path, text) of all containers whose path has this key, a line for each block; None if the page has none. The empty path is the whole page."""
    paths = Paths()
    hashes = [hashlib.blake2b(digest_size=8)]  # of the paths' names, each from that of the path above it
    out: list[str] = []
    path = [0]
    hits: list[bool] = []
    quiet = 0
    whole = wanted == path_key("")
    wanted_bytes = wanted.to_bytes(8, "little", signed=True)
    inside, name = int(whole), "" if whole else None
    for what, value, attributes in events(page):
        if what == "text":
            if inside and not quiet:
                out.append(_SPACE.sub(" ", entities.unescape(value) if "&" in value else value))
            continue
        if what == "open":
            node = paths.below(path[-1], value, attributes)
            if node == len(hashes):
                h = hashes[path[-1]].copy()
                h.update((">" * (path[-1] > 0) + paths.step[node]).encode("utf-8", "surrogatepass"))
                hashes.append(h)
            path.append(node)
            quiet += value in NOISE
            hits.append(value in CONTAINERS and not whole and hashes[node].digest() == wanted_bytes)
            inside += hits[-1]
            if hits[-1] and name is None:
                name = paths.name(node)
        else:
            path.pop()
            inside -= hits.pop()
            quiet -= value in NOISE
        if value in BLOCKS:
            out.append("\n")
    if name is None:
        return None
    lines = (re.sub(r" +", " ", x).strip() for x in "".join(out).split("\n"))
    return name, "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_votes: int = LEAST_VOTES) -> DataFrame:
    """(page_id, host, path, consensus, text) for each page with a text.

    host is that of the url in lower case, without www. A page whose host has a path with least_votes
    votes is extracted by the path with most (then with the higher sum of scores, then the first by
    name), consensus true; a page that has no container of that path, whose host has no such path or
    whose url is null or has no host, by its own best, consensus false. A null or empty page and one
    without a text outside navigation have no row. Ids may be null or repeat: rows are taken each, and
    each votes. An empty table gives no rows; other columns are not read; pages are read whole, however long,
    and in time in proportion to their length. What joins the pages is a host and a 64-bit key of its path.
    """
    pages = bounded(pages)
    host = F.nullif(F.lower(F.regexp_extract(F.col(url_col), HOST, 1)), F.lit(""))
    raw = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("page_id"), host.alias("host"), F.col(html_col).alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(h, path_key(x[0]), *x) for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (x := best(page))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.float64()))], names=["h", "voted", "path", "score"])

    votes = raw.where("host IS NOT NULL").select("host", "html").mapInArrow(vote, "h string, voted long, path string, score double")
    counted = votes.groupBy("h", "voted").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("s"), F.min("path").alias("path"))
    first = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("n"), F.desc("s"), "path"))
    winners = written(counted.where(F.col("n") >= least_votes).withColumn("k", first).where("k = 1").select("h", "voted"), "winners")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (page, voted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                got, agreed = (text_of(page, voted) if voted is not None else None), True
                if not got or not got[1]:
                    own = best(page)
                    if own is None:
                        continue
                    got, agreed = text_of(page, path_key(own[0])), False
                if got and got[1]:
                    rows.append((i, got[0], agreed, got[1]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.string()), (2, pa.bool_()), (3, pa.string())))], names=["page_id", "host", "path", "consensus", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    joined = raw.join(sized(winners), raw["host"] == winners["h"], "left").select("page_id", "host", "html", "voted")
    return joined.mapInArrow(again, f"page_id {kind}, host string, path string, consensus boolean, text string")
