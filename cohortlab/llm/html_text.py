"""Main text of web pages by consensus paths per host.

1.  Each page is scanned once into text blocks and the containers that hold
    them. A container scores the characters of its own blocks outside links,
    half of its children's and a quarter of its grandchildren's; ``article`` and
    ``main`` count more. Menus, headers, footers, asides, forms, scripts, styles
    and containers whose class or id names an advert, notice, sidebar or reader
    comment hold no content.
2.  A page votes for the tag-class path of its best container (digits dropped).
    Votes are counted per host and path in Spark. Pages of a host with the same
    container paths share a template; of each template's paths the one with the most
    votes on the host wins (then the shortest, then the first in the alphabet).
3.  Each page is extracted again by its template's winning path: the containers on
    that path; else, where nothing on the host has a vote, its own best container.

Votes, templates and their paths are rows, so a host may have any number of them:
nothing is capped, and no group of a host meets in one task. Pages are joined by
host and template; the winning paths are broadcast while they measure small.

Character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined by a newline in page order; empty blocks fall away.
Null or empty html has an empty text. A page without a host votes in a group
of its own. Repeated rows are extracted alike. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha1
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import BROADCAST_BYTES, Scratch
from cohortlab.llm.url_filter import host_of

# Element names and class words.
RAW = frozenset("script style noscript template iframe svg math textarea title select object canvas audio video".split())
BOILER = frozenset("head nav header footer aside form button menu dialog".split())
STRUCTURE = BOILER | frozenset(
    "html body main article section div ul ol dl li dt dd table thead tbody tfoot tr td th "
    "figure figcaption blockquote center fieldset details summary address hgroup search".split())
BLOCK = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 pre hr caption legend option".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CONTAINER = frozenset("body main article section div td blockquote center".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall "
    "sidebar sidebars side rail widget widgets related recommended recommendations "
    "comment comments commentlist disqus replies reply respond discussion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer copyright share sharing social login search skip "
    "complementary contentinfo".split())
#: A name such as ``with-sidebar`` tells what lies beside a container, not what it is.
BESIDE = frozenset("with without has no non not".split())
_SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
               "th": {"tr", "table"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_FIRST_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _name_words(attrs: str) -> set[str]:
    out: set[str] = set()
    for m in _CLASS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if words and words[0] not in BESIDE:
                out.update(words)
    return out


class Page:
    """Blocks and containers of one page."""

    def __init__(self, html: str | None):
        # a container: [parent, path, score, is boilerplate, tag]
        self.nodes: list[list] = [[-1, "", 0.0, False, "html"]]
        self.blocks: list[tuple[int, str]] = []
        if html:
            self._scan(html)

    def _flush(self, at: int, buf: list[str], linked: int) -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text and not self.nodes[at][3]:
                self.blocks.append((at, text))
                own, share = max(len(text) - linked, 0), 1.0
                for _ in range(3):
                    self.nodes[at][2] += own * share
                    at, share = self.nodes[at][0], share / 2
                    if at < 0:
                        break

    def _scan(self, html: str) -> None:
        nodes, pos, at, depth_a, linked, buf = self.nodes, 0, 0, 0, 0, []
        n = len(html)
        while pos < n:
            m = _TAG.search(html, pos)
            text = html[pos:m.start() if m else n]
            if text:
                text = unescape(text)
                buf.append(text)
                if depth_a:
                    linked += len(text.strip())
            if not m:
                break
            pos = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[5], m[6], m[7])
            if not tag or not (m[4] or m[8]):          # comment, declaration, or cut off at the end
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self._flush(at, buf, linked)
                linked = 0
            elif tag == "br":
                buf.append("\n")
            if tag == "a":
                depth_a = 0 if close else 1
            elif close:
                if tag in STRUCTURE:
                    up = at
                    while up > 0 and nodes[up][4] != tag:
                        up = nodes[up][0]
                    if up > 0:
                        at = nodes[up][0]
            elif tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, pos)
                    stop = html.find(">", end.start()) if end else -1
                    pos = stop + 1 if stop >= 0 else n
            elif tag in STRUCTURE:
                depth_a = 0
                if tag in _SAME_LEVEL:                 # an item closes the item before it
                    up = at
                    while up > 0 and nodes[up][4] != tag and nodes[up][4] not in _SAME_LEVEL[tag]:
                        up = nodes[up][0]
                    if up > 0 and nodes[up][4] == tag:
                        at = nodes[up][0]
                if tag in ("html", "body") and any(x[4] == tag for x in nodes[1:]):
                    continue
                words = _name_words(attrs)
                boiler = (nodes[at][3] or tag in BOILER
                          or (tag not in ("html", "body", "main", "article") and bool(words & BOILER_WORDS))
                          or (tag == "article" and bool(words & {"comment", "comments", "reply"}))
                          or bool(_HIDDEN.search(attrs)))
                c = _FIRST_CLASS.search(attrs)
                name = re.sub(r"\d+", "", (c[1] or c[2] or c[3] or "").strip().lower()) if c else ""
                name = ".".join(sorted({w for w in name.split() if w}))
                nodes.append([at, f"{nodes[at][1]}>{tag}{'.' + name if name else ''}", 0.0, boiler, tag])
                at = len(nodes) - 1
        self._flush(at, buf, linked)

    def best(self) -> int:
        """Number of the best container, -1 without any text."""
        top, found = 0.0, -1
        for i, (_, _, score, boiler, tag) in enumerate(self.nodes):
            if not boiler and (tag in CONTAINER or i == 0):
                s = score * (2.0 if tag in ("article", "main") else 0.5 if tag in ("body", "html") else 1.0)
                if s > top:
                    top, found = s, i
        return found

    def paths(self) -> list[str]:
        """The distinct paths of the page's containers, sorted: what it may be extracted by."""
        return sorted({x[1] for i, x in enumerate(self.nodes) if not x[3] and (x[4] in CONTAINER or i == 0)})

    def text(self, path: str | None) -> str:
        """Text of the containers on ``path``; without one, of the best container."""
        roots = {i for i, x in enumerate(self.nodes) if not x[3] and x[1] == path}
        if not roots:
            best = self.best()
            if best < 0:
                return ""
            roots = {best}
        inside = [False] * len(self.nodes)
        for i, x in enumerate(self.nodes):             # parents come before their children
            inside[i] = i in roots or (x[0] >= 0 and inside[x[0]])
        return "\n".join(t for at, t in self.blocks if inside[at])


def template(paths: list[str]) -> str:
    """Name of a template: the digest of its container paths."""
    return sha1("\n".join(paths).encode("utf-8", "surrogatepass")).hexdigest()


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got: dict[tuple[str, str, str], int] = {}
        paths: dict[str, list[str]] = {}
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            page = Page(html)
            i = page.best()
            if i >= 0:
                own = page.paths()
                t = template(own)
                paths[t] = own
                k = (host, t, page.nodes[i][1])
                got[k] = got.get(k, 0) + 1
        yield pd.DataFrame([(*k, paths[k[1]], n) for k, n in got.items()],
                           columns=["host", "template", "path", "paths", "votes"])


def _templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(template=[template(Page(h).paths()) for h in pdf["html"]])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [Page(h).text(p) for h, p in zip(pdf["html"], pdf["path"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text,
                            "n_chars": [len(t) for t in text]})


def host_paths(pages: DataFrame, sc: Scratch) -> DataFrame:
    """``host, template, path``: the path that wins the vote for each template of a host."""
    src = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    seen = sc.put("seen", src.mapInPandas(
        _votes, "host string, template string, path string, paths array<string>, votes bigint")
        .groupBy("host", "template", "path").agg(F.sum("votes").alias("votes"), F.first("paths").alias("paths")))
    votes = seen.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    own = seen.groupBy("host", "template").agg(F.first("paths").alias("paths")) \
        .select("host", "template", F.explode("paths").alias("path"))
    order = F.struct((-F.col("votes")).alias("v"), F.length("path").alias("n"), "path")
    return own.join(votes, ["host", "path"]).groupBy("host", "template").agg(F.min(order)["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    sc = Scratch(pages.sparkSession, "html-text")
    paths = sc.put("paths", host_paths(pages, sc))
    sc.drop("seen")
    size = paths.agg(F.sum(F.octet_length(F.concat("host", "template", "path")) + 64)).first()[0] or 0
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"),
                       host_of(F.col("url")).alias("host"))
    id_type, url_type = (dict(src.dtypes)[c] for c in ("page_id", "url"))
    row = f"page_id {id_type}, url {url_type}"
    named = src.mapInPandas(_templates, f"{row}, html string, host string, template string")
    joined = named.join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, ["host", "template"], "left")
    return joined.select("page_id", "url", "html", "path").mapInPandas(
        _extract, f"{row}, text string, n_chars bigint")
