"""Main text of web pages by consensus host paths (operator 6).

Each page's containers are scored by the text of their blocks less what is in links. The path of the best one
(tags with classes, digits generalised) is the page's vote; Spark counts the votes of each host, and every page
is extracted again from the container at its host's winning path, or from its own best one if it has none
there. Elements that are never main text, by tag or by class, are left out at any depth; but one left out by
class only is read after all if the page's article or main is in it, or most of its unlinked text.

The best container is often a part of the article. Before the vote and before the extraction it gives way to the
article or main around it, then to any container around it that adds more text than links and boilerplate.

Only votes are shuffled, summed before that; a host's pages never meet in one task. Winners go to the pages by
broadcast while there are at most HOSTS hosts; with more, pages are joined by host, the hot ones dealt over
SALTS parts each.

Defined results: a null or empty page, or one without text, gives an empty text; a null URL votes for the
empty host; repeated rows give repeated rows, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .common import slices, table
from .url_filter import parts

HOSTS, SALTS = 20_000, 32

#: Comments, tags without angle brackets in their quotations, and text; tag() reads what else begins with "<".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|([^<]++)", re.S)
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
SPECIAL = re.compile(r"[>\"']")
#: Decimal references that int() doesn't take.
LONG_REFERENCE = re.compile(r"&#([0-9]{1000,});?")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Tags that never hold main text.
NEVER = frozenset("script style noscript template iframe object svg math canvas head title nav header footer aside form button select textarea option dialog menu datalist audio video map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
#: Words of classes, ids and roles that mark what is around the main text.
AROUND = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert comment comments commentlist respond disqus sidebar aside rail menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot header masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup widget skip toolbar contentinfo complementary search".split())
#: Parts that may follow such a word in a class ("sidebar-left"), and parts before it that say that it is not one ("has-sidebar").
PIECES = frozenset("left right top bottom upper lower list lists box bar area slot unit inner outer wrap wrapper container holder links link buttons button icons icon block item items section posts widgets articles primary secondary tertiary main form title text body content header footer desktop mobile sticky fixed".split())
NOT = frozenset("has have with without no not is hide after before below above".split())
#: Words of comments, which may well hold more text than the article.
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Short blocks of what stands around the main text.
BOILERPLATE = re.compile(r"\A\W*(?:©|copyright\b)|\ball rights reserved\b|\bterms of (?:use|service)\b|\bprivacy (?:policy|statement)\b|\bpowered by\b", re.I)
#: A start tag of these ends an open one of the same kind.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def around_words(marks: str) -> set[str]:
    """Words of AROUND that classes, ids or roles are, end with, or begin with before nothing but PIECES."""
    found = set()
    for token in marks.split():
        words = [w for w in re.split(r"[^a-z]+", CAMEL.sub(r"\1 \2", token).lower()) if w]
        if not words or words[0] in NOT:
            continue
        if words[-1] in AROUND:
            found.add(words[-1])
        elif words[0] in AROUND and PIECES.issuperset(words[1:]):
            found.add(words[0])
    return found


def unescape(text: str) -> str:
    if "&#" in text:
        text = LONG_REFERENCE.sub(lambda m: f"&#{m[1].lstrip('0')[:8]};", text)
    return entities.unescape(text)


class Node:
    """out: never main text; region: the element, ruled out by class, that this is in, or 0; main: it is in an article or main."""

    __slots__ = ("tag", "path", "container", "out", "link", "region", "main")

    def __init__(self, tag: str, path: int, container: int, out: bool, link: bool, region: int, main: bool):
        self.tag, self.path, self.container, self.out, self.link, self.region, self.main = tag, path, container, out, link, region, main


class Stack:
    """Open elements, with the places of each tag and of the containers, so that none is looked for."""

    def __init__(self) -> None:
        self.nodes = [Node("", 0, 0, False, False, 0, False)]
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def last_container(self) -> int:
        return self.containers[-1] if self.containers else 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in CONTAINER:
            self.containers.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Ends the k-th element and all in it."""
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
            if node.tag in CONTAINER:
                self.containers.pop()
        del self.nodes[k:]


class Page:
    """One pass over a page: the blocks of text, each with the containers around it. Time and memory are linear in the page."""

    def __init__(self, text: str):
        self.start(frozenset())
        self.read(text)
        if spared := self.spared():
            self.start(spared)
            self.read(text)
        for i in range(len(self.paths) - 1, 0, -1):  # from here on with the containers inside
            self.good[self.parent[i]] += self.good[i]
            self.bad[self.parent[i]] += self.bad[i]
        self.find_wholes()

    def start(self, spared: frozenset[int]) -> None:
        #: regions ruled out by class: the one around each, unlinked characters, articles and mains, whether it is in one, whether it is of comments
        self.spare = spared
        self.within, self.chars, self.mains, self.inside, self.comments = [-1], [0], [0], [False], [False]
        #: tag, path, parent and score of each container; characters of its own blocks that are text, and that are links or boilerplate
        self.tags, self.paths, self.parent, self.score = [""], [0], [-1], [0.0]
        #: paths by number: the one around and the last step; numbers by these
        self.steps: list[tuple[int, str]] = [(0, "")]
        self.numbers: dict[tuple[int, str], int] = {}
        self.good, self.bad = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.linked = 0

    def spared(self) -> frozenset[int]:
        """Regions that are the page's main text, or hold it, whatever their classes say."""
        n = len(self.within)
        chars, mains = list(self.chars), list(self.mains)
        for i in range(n - 1, 0, -1):
            chars[self.within[i]] += chars[i]
            mains[self.within[i]] += mains[i]
        inner: dict[int, list[int]] = {}
        for i in range(1, n):
            inner.setdefault(self.within[i], []).append(i)
        spared, free, near = [], self.mains[0], inner.get(0, [])
        while True:
            # those with the article, unless one is outside of them; those with most of the text, unless the article is elsewhere
            may = [i for i in near if mains[i] and not free] or [i for i in near if 2 * chars[i] > chars[0] and not self.comments[i] and (self.inside[i] or not free)]
            if not may:
                return frozenset(spared)
            i = max(may, key=lambda i: chars[i])
            spared.append(i)
            near = [j for j in near if j != i] + inner.get(i, [])
            free += self.mains[i]

    def flush(self, container: int) -> None:
        if not self.buffer:
            return
        text = " ".join(unescape("".join(self.buffer)).split())
        if text:
            self.blocks.append((container, text))
            worth = max(0.0, len(text) - 2.0 * self.linked)
            (self.good if worth and not (len(text) < 200 and BOILERPLATE.search(text)) else self.bad)[container] += len(text)
            share = 1.0
            while container > 0 and share > 0.2:
                self.score[container] += worth * share
                container, share = self.parent[container], share / 2
        self.buffer, self.linked = [], 0

    def tag(self, text: str, at: int) -> tuple[int, str, str, str]:
        """(end, slash, name, attributes) of what begins with "<" but isn't a plain tag; without a name it is text."""
        if text[at + 1 : at + 2] in ("!", "?"):
            end = text.find(">", at) if at < self.ends[">"] else -1
            return (end + 1, "", "", "") if end >= 0 else (at + 1, "", "", "<")
        m = NAME.match(text, at)
        if not m:
            return at + 1, "", "", "<"
        if self.ends[">"] < at:
            # a tag that the page breaks off
            return (len(text), "", "", "") if self.ends["<"] == at else (at + 1, "", "", "<")
        p, passed = m.end(), []
        while q := SPECIAL.search(text, p):
            if q[0] == ">":
                return q.end(), m[1], m[2], text[m.end() : q.start()]
            close = text.find(q[0], q.end()) if q.end() <= self.ends[q[0]] else -1
            p = close + 1
            # whoever comes to the same place outside of quotations goes on alike
            if close < 0 or p in self.open_ended:
                break
            passed.append(p)
        self.open_ended.update(passed)
        end = text.find(">", m.end())
        return end + 1, m[1], m[2], text[m.end() : end]

    def read(self, text: str) -> None:
        stack = Stack()
        self.ends = {c: text.rfind(c) for c in "<>\"'"}
        self.open_ended: set[int] = set()
        at, size = 0, len(text)
        while at < size:
            m = TOKEN.match(text, at)
            if m:
                at = m.end()
                said, slash, tag, rest = m[4], m[1], m[2], m[3]
            else:
                at, slash, tag, rest = self.tag(text, at)
                said, rest = (rest, "") if not tag else (None, rest)
            if said:
                top = stack.nodes[-1]
                if top.out:
                    continue
                if not top.link:
                    self.chars[top.region] += len(said.strip())
                if not top.region or top.region in self.spare:
                    self.buffer.append(said)
                    if top.link:
                        self.linked += len(said)
                continue
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self.close(stack, tag)
                continue
            if tag in VOID:
                if tag == "br":
                    self.buffer.append(" ")
                elif tag == "hr":
                    self.flush(stack.nodes[-1].container)
                continue
            self.open(stack, tag, rest)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(text, at)
                at = text.find(">", end.end()) + 1 if end and end.end() <= self.ends[">"] else size
                stack.cut(len(stack.nodes) - 1)
        self.flush(stack.nodes[-1].container)

    def step(self, path: int, name: str) -> int:
        """The number of a path that goes on with an element."""
        key = (path, name)
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.steps)
            self.steps.append(key)
        return got

    def path_of(self, i: int) -> str:
        """The path of a container, as text."""
        out, p = [], self.paths[i]
        while p:
            p, name = self.steps[p]
            out.append(name)
        return "".join("/" + x for x in reversed(out))

    def number_of(self, path: str | None) -> int:
        """The number of a path; -1 if the page has none."""
        p = 0
        for name in (path or "").split("/")[1:]:
            p = self.numbers.get((p, name), -1)
        return p or -1

    def open(self, stack: Stack, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush(stack.nodes[-1].container)
            # a block ends an open paragraph
            end = max(stack.last("p"), *(stack.last(x) for x in ENDS.get(tag, ())), 0)
            limit = max(stack.last_container(), *(stack.last(x) for x in LIMITS.get(tag, ())), 0)
            if end and end >= limit:
                stack.cut(end)
        top = stack.nodes[-1]
        marks = names = ""
        hidden = False
        if rest:
            for a in ATTRIBUTE.finditer(rest):
                value = a[2] or a[3] or a[4] or ""
                name = a[1].lower()
                if name in ("hidden", "aria-hidden"):
                    hidden = hidden or name == "hidden" or value.lower() == "true"
                else:
                    marks += " " + value
                    names += "." + ".".join(sorted(value.split())) if name == "class" and value else ""
        main = tag in ("article", "main")
        never = top.out or tag in NEVER or (hidden and not main and tag not in ("body", "html"))
        words = around_words(marks) if marks and not never and tag not in ("body", "html") else ()
        region = top.region
        if main:
            # an article of the class comment is not the page's
            self.mains[region] += not words and not never
        elif words:
            self.within.append(region)
            self.chars.append(0)
            self.mains.append(0)
            self.inside.append(top.main)
            self.comments.append(not COMMENTS.isdisjoint(words))
            region = len(self.within) - 1
        out = never or (region > 0 and region not in self.spare)
        path = self.step(top.path, tag + re.sub(r"\d+", "#", names).replace("/", "|")) if tag in BLOCK and not out else top.path
        container = top.container
        if tag in CONTAINER and not out:
            self.tags.append(tag)
            self.paths.append(path)
            self.parent.append(container)
            self.score.append(0.0)
            self.good.append(0)
            self.bad.append(0)
            container = len(self.paths) - 1
        stack.push(Node(tag, path, container, never, top.link or tag == "a", region, top.main or main))

    def close(self, stack: Stack, tag: str) -> None:
        k = stack.last(tag)
        if k and (k > stack.last_container() or tag in CONTAINER or tag == "html"):
            if tag in BLOCK:
                self.flush(stack.nodes[-1].container)
            stack.cut(k)

    def best(self) -> int:
        """The container with the most text; main elements count more, and of equals the first wins."""
        found, most = 0, 0.0
        for i in range(1, len(self.paths)):
            worth = self.score[i] * (1.5 if self.tags[i] in ("article", "main") else 1.0)
            if worth > most:
                found, most = i, worth
        return self.wholes[found]

    def find_wholes(self) -> None:
        """Of each container that of the whole article that it is, or is a part of: the outermost article or main around
        it, and from there any container around that adds more text than links and boilerplate."""
        n = len(self.paths)
        self.wholes = [0] * n
        outer: dict[str, list[int]] = {tag: [0] * n for tag in ("article", "main")}
        most = [0] * n  # the container with the most text less boilerplate among this and those around, the nearest of equals
        for i in range(1, n):  # parents come before their children
            up = self.parent[i]
            for tag, found in outer.items():
                found[i] = found[up] or (i if self.tags[i] == tag else 0)
            best = most[up]
            most[i] = best if best and self.good[best] - self.bad[best] > self.good[i] - self.bad[i] else i
            self.wholes[i] = most[outer["article"][i] or outer["main"][i] or i]

    def text(self, path: str | None) -> str:
        p = self.number_of(path)
        at = [self.wholes[i] for i in range(1, len(self.paths)) if self.paths[i] == p and self.score[i] > 0] or [self.best()]
        inside = set(at)
        for i in range(len(self.paths)):  # parents come before their children
            if self.parent[i] in inside:
                inside.add(i)
        return "\n".join([t for c, t in self.blocks if c in inside])


def host_votes(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (host, path, votes, score), the votes of each host."""
    schema = "host string, path string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, paths, scores = [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(text)
                i = page.best()
                if i:
                    hosts.append(host)
                    paths.append(page.path_of(i))
                    scores.append(page.score[i])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return pages.select("host", "html").mapInArrow(run, schema).groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("score")).alias("score"))


def extract_html(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hosts: int = HOSTS) -> DataFrame:
    """One row per row of pages: id_col, url, text, n_chars, path (the host's winning path, null if none)."""
    from .common import materialize

    host, _ = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    winners = host_votes(rows).groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))
    winners = materialize(winners, "host-paths")
    if winners.count() <= hosts:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "id"), F.lit(SALTS)))
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(salted, ["host", "salt"], "left")
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [Page(h).text(p) for h, p in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column(2)], names=schema.names)

    return rows.select("id", "url", "path", "html").mapInArrow(run, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spread(table(spark, sf_dir, "pages")))
