"""Main text of web pages by consensus of a host's pages.

1. Every page is read into blocks, each under the path of its containers. A container's score is the text of its blocks,
   less what stands in links, halved with every level in between; menus, adverts and the like don't count.
2. Spark sums the pages' votes per host and generalised path (tags and classes without numbers); each host's best path wins.
3. Every page is read again and gives the blocks under the winning path, or, where that path is absent, under its
   own best container.

A path is a node whose mark is the digest of its parent's mark and its own name, so pages of a host agree on marks, and reading a
page takes time that is linear in its length, however deep it is.

What is not the article is told by tags, roles and hidden attributes, and by class and id: by whole names (`sidebar`,
`cookie-notice`, `sidebar-left`) and not by parts of others (`no-sidebar`, `social-science`). Where class names would leave a page
without any text, they don't count. A `header` outside of `article` and `main` is the page's; it only stays if it holds a headline
and lies within the winning container, and that isn't the whole page.

Blocks are joined by two line ends, white space inside a block becomes one space. Nothing is cut off. Null pages and pages
without text give an empty text. Pages without a host vote together under an empty one. Rows that repeat get equal texts and each
has its vote; equal votes go to the path nearer to the root, then by mark. An empty table gives an empty table; only page_id,
url and html are read, whatever other columns are called.
"""

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import schema
from assetweave.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
WORD = re.compile(r"[a-z]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var label".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
CLOSES_P = {"p"}  # a block's start ends an open paragraph
OTHER = set("nav footer aside form script style noscript template head button select option dialog svg math object audio video "
            "canvas menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
HINTS = set("ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner cookie cookies consent notice "
            "notices popup popups modal overlay sidebar sidebars menu menus submenu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
            "comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription "
            "login signup toolbar pagination pager".split())
PLACES = set("left right top bottom box bar block wrapper wrap container inner outer list area section site page global main primary secondary "
             "first last mobile desktop sticky fixed links items item form icons buttons panel column col row widget widgets slot unit space post".split())
HARD, HINT, HEAD = 1, 2, 4  # why a block may not be part of the article
LEAST = 140  # unlinked characters under class names that speak against the article but hold all there is
HEADLINES = ("h1", "h2", "h3")


class Page:
    """Blocks of a page as (node, text, characters in links, why it may not be the article, number of its header)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self._parent, self._name, self._mark, self._depth = [-1], [""], [b""], [0]
        self._child: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, node, why not, header
        self._open_tags: Counter = Counter()
        self._headers, self._titled = 0, set()
        self._text: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(html)
        self._flush()
        seen = [b for b in self.blocks if not b[3]]
        hinted = sum(max(0, len(b[1]) - 2 * b[2]) for b in self.blocks if b[3] & HINT and not b[3] & HARD)
        self._never = HARD if not seen and hinted >= LEAST else HARD | HINT

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            m = TOKEN.match(html, at)
            if m is None:  # no token begins here: a character of text
                self._text.append(html[at])
                at += 1
                continue
            at = m.end()
            if (text := m["text"]) is not None:
                self._add(unescape(text))
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self._close(tag)
                continue
            rest = m["rest"] if m["rest"] is not None else m["rest2"]
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                continue
            self._open(tag, rest or "")

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split()) if self._text else ""
        if text:
            tag, node, why, header = self._stack[-1]
            self.blocks.append((node, text, self._linked, why, header))
            if header and tag in HEADLINES:
                self._titled.add(header)
        self._text, self._linked = [], 0

    def _node(self, parent: int, name: str) -> int:
        at = self._child.get((parent, name))
        if at is None:
            at = self._child[parent, name] = len(self._parent)
            self._parent.append(parent)
            self._name.append(name)
            self._depth.append(self._depth[parent] + 1)
            self._mark.append(blake2b(self._mark[parent] + name.encode("utf-8", "replace"), digest_size=16).digest())
        return at

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        name, why = _described(tag, rest)
        if tag in INLINE:
            self._in_link = self._in_link or tag == "a"
            if not why:
                return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
            self._in_link = False
            self._end_open({"p"})
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._end_open({tag}, {"ul", "ol", "table", "dl", "menu", "select"})
        if tag in ("html", "body") and self._open_tags[tag]:
            return
        if tag in INLINE:
            self._flush()
        _, node, above, header = self._stack[-1]
        if tag == "header" and not (self._open_tags["article"] or self._open_tags["main"]):
            self._headers += 1
            why, header = why | HEAD, self._headers
        self._stack.append((tag, self._node(node, name), above | why, header))
        self._open_tags[tag] += 1

    def _drop(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for entry in self._stack[k:]:
            self._open_tags[entry[0]] -= 1
        del self._stack[k:]

    def _end_open(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """Ends the innermost open element of these tags unless another container lies between."""
        if not any(self._open_tags[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                self._flush()
                self._drop(k)
                return
            if self._stack[k][0] in within or self._stack[k][0] in ("div", "section", "article", "main", "body", "nav", "footer", "aside", "header"):
                return

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if not self._open_tags[tag] or tag in ("html", "body"):
            if tag not in INLINE and tag != "br":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        self._flush()
        self._in_link = False
        k = len(self._stack) - 1
        while self._stack[k][0] != tag:
            k -= 1
        self._drop(k)

    def scores(self) -> list[float]:
        """Score of each node: what its blocks are worth, and half of each child's. Children come after their parents."""
        scores = [0.0] * len(self._parent)
        for node, text, linked, why, _ in self.blocks:
            if not why & (self._never | HEAD):
                own = self._parent[node] if self._name[node].split(".", 1)[0] in LEAVES else node
                scores[own] += max(0, len(text) - 2 * linked)
        for node in range(len(scores) - 1, 0, -1):
            above = self._parent[node]
            if self._name[above].split(".", 1)[0] not in ("html", "body"):
                scores[above] += scores[node] / 2
        scores[0] = 0.0  # what lies in no container has no path
        return scores

    def votes(self) -> list[tuple[bytes, int, float]]:
        """(mark, depth, score in shares of the best) of the page's containers."""
        scores = self.scores()
        best = max(scores)
        return [(self._mark[i], self._depth[i], s / best) for i, s in enumerate(scores) if s > 0] if best > 0 else []

    def find(self, mark: bytes | None) -> int | None:
        """The node of a path, if the page has it."""
        return self._mark.index(mark) if mark is not None and mark in self._mark else None

    def under(self, winner: int) -> list[str]:
        inside = [False] * len(self._parent)
        for node in range(winner, len(inside)):
            inside[node] = node == winner or (node > 0 and inside[self._parent[node]])
        part = winner > 0 and self._name[winner].split(".", 1)[0] not in ("html", "body")
        return [text for node, text, _, why, header in self.blocks if inside[node] and not why & self._never
                and (not why & HEAD or (part and header in self._titled))]

    def own(self) -> int:
        scores = self.scores()
        best = max(scores)
        return max((i for i, s in enumerate(scores) if s == best), key=lambda i: (-self._depth[i], self._mark[i])) if best > 0 else 0

    def text(self, mark: bytes | None) -> str:
        at = self.find(mark)
        blocks = self.under(at) if at is not None else []
        return "\n\n".join(blocks or self.under(self.own()))

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self._name[node])
            node = self._parent[node]
        return "/".join(reversed(names))


def _against(names: str) -> bool:
    """Whether one of the names says as a whole that this is not the article: hints, alone or with a place or a number."""
    for name in names.split():
        parts = [w.lower() for w in PART.findall(name)]
        if any(w in HINTS for w in parts) and all(w in HINTS or w in PLACES for w in parts):
            return True
    return False


def _described(tag: str, rest: str) -> tuple[str, int]:
    """The generalised name of an element, and why it may not be the article."""
    if "=" not in rest and "hidden" not in rest:
        return tag, HARD if tag in OTHER else 0
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        key = (m[1] or m[5]).lower()
        values.setdefault(key, unescape(m[2] or m[3] or m[4] or ""))
    said = values.get("class", "")
    hard = tag in OTHER or values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true"
    hint = tag not in ("html", "body", "article", "main") and (_against(said) or _against(values.get("id", "")))
    return ".".join([tag, *dict.fromkeys(WORD.findall(said.lower()))]), HARD * hard | HINT * hint


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of a task's pages, summed per host and path."""
    for batch in batches:
        votes: dict[tuple[str, bytes, int], float] = {}
        for host, html in zip(batch.column(0), batch.column(1), strict=True):
            h = host.as_py()
            for mark, depth, score in Page(html.as_py()).votes():
                votes[h, mark, depth] = votes.get((h, mark, depth), 0.0) + score
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in votes], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int32()))]
            + [pa.array(list(votes.values()), pa.float64())], ["host", "mark", "depth", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(html.as_py() or "").text(mark.as_py()) for html, mark in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, mark): the container path that wins each host's vote; ties go to the one nearer to the root, then by mark."""
    votes = pages.filter(F.col("html").isNotNull()).select(_host().alias("host"), "html").mapInArrow(
        _vote, schema("host string, mark binary, depth int, votes double"))
    summed = votes.groupBy("host", "mark", "depth").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", -F.col("depth"), "mark"))["mark"].alias("mark"))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text."""
    # a row per host, written so that its size is known: small, it goes to the pages; large, AQE splits a host's pages
    winners = cut_lineage(host_paths(pages), "host_paths")
    held = pages.select("page_id", "url", "html", _host().alias("_host")).join(
        winners.withColumnRenamed("host", "_winner"), F.col("_host") == F.col("_winner"), "left")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return held.select("page_id", "url", "html", "mark").mapInArrow(_extract, schema(f"page_id {id_type}, url string, text string"))
