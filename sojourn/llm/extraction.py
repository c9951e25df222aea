"""Main text of web pages by gradient-boosted trees over the nodes of the document tree.

Each element is described by its tag, tokens of its class, id and role and those of its ancestors, depth, place among its
siblings, and the amounts and densities of text, links and marks in its subtree. Boosted trees give the chance that it belongs to
the main text. Decoding is hierarchical: dropping an element drops all below it, so the most likely consistent choice is
found from the leaves up, where every element compares dropping its whole subtree with keeping itself and the best of
its children.

The trees are trained on a bounded sample of the pages. Elements of a page that say what they are (``article``, ``nav``, ...)
are taken apart, and the same texts are put together again as pages of other builds (sections named by class or id only, side
bars, reader comments, notices, forms), whose labels are known.

Null and empty html give an empty text. Broken markup is read as browsers do: unclosed elements end with their parents, what
is no tag is text, and an unclosed script, style, title, text area or frame takes the rest of the page. Of an unclosed ``noscript``
or ``template`` only the tag is left out. Rows that repeat are extracted each, pages of any length whole. An empty table gives no rows. A column
named like the result is replaced.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import trees
from sojourn.llm.words import attach, emit

SAMPLE = 240
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup, elements that are not shown, and elements in which a tag may close itself.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("noscript template".split())
FOREIGN = frozenset("svg math".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
HIDDEN_TAG = {t: re.compile(rf"<!--.*?(?:-->|\Z)|<script[\s/>].*?(?:</script|\Z)|<(/?){t}(?=[\s/>])", re.I | re.A | re.S) for t in HIDDEN}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What an opening tag ends, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, set())}
GROUPS = ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tr td th", "a",
          "nav", "header", "footer", "aside", "form input label fieldset", "head", "html body", "blockquote pre figure figcaption",
          "b strong em i u span small font")
GROUP_OF = {tag: i for i, g in enumerate(GROUPS) for tag in g.split()}
GOOD = "article articlebody content main post entry story body text page single blog news".split()
BAD = ("nav navigation navbar menu footer foot header head masthead sidebar side aside ad ads advert advertisement adsense sponsor sponsored promo "
       "banner cookie cookies consent notice alert comment comments reply disqus share social related recommended form login signup "
       "subscribe newsletter search popup modal breadcrumb breadcrumbs widget copyright legal tags meta skip pager pagination toolbar").split()
TOKEN_OF = {t: i for i, t in enumerate(GOOD + BAD)}
BUCKETS = 12


class Page:
    """Elements in document order with parents, and the pieces of text with the block that each lies in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs, self.depths = ["#"], [-1], [""], [0]
        self.texts: list[tuple[int, int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, block, at, end = [0], 0, 0, len(source)
        tags = self.tags
        endless, bodies = set(), {}
        while at < end:
            found = TOKEN.search(source, at)
            upto = found.start() if found else end
            if upto > at:
                piece = source[at:upto]
                self.texts.append((stack[-1], block, html.unescape(piece) if "&" in piece else piece))
            if not found:
                break
            at, name = found.end(), found[2]
            if not name:
                continue
            name = name.lower()
            if name not in INLINE and name not in SILENT:
                block += 1
            elif name == "br":
                self.texts.append((stack[-1], block, " "))
            if found[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if name in INLINE and tags[stack[k]] not in INLINE:
                        break
                continue
            if name in ENDS_P:
                self._end(stack, {"p"}, {"table", "td", "th", "button"})
            if name in CLOSES:
                self._end(stack, *CLOSES[name])
            tags.append(name)
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.attrs.append(found[3])
            if name in VOID or found[3].endswith("/") and (name in FOREIGN or self._foreign(stack)):
                continue
            if name in RAW:
                close = None if name in endless else RAW_END[name].search(source, at)
                if close:
                    at = source.find(">", close.end()) + 1 or end
                    continue
                if not self._foreign(stack):
                    return
                endless.add(name)
                continue
            if name in HIDDEN:
                if name not in bodies:
                    bodies[name] = self._bodies(source, name)
                close = bodies[name].get(found.start())
                if close is not None:
                    at = source.find(">", close) + 1 or end
                continue
            stack.append(len(tags) - 1)

    def _foreign(self, stack: list[int]) -> bool:
        for k in reversed(stack):
            if self.tags[k] in FOREIGN or self.tags[k] == "foreignobject":
                return self.tags[k] in FOREIGN
        return False

    @staticmethod
    def _bodies(source: str, name: str) -> dict[int, int]:
        """Where each element of that name begins and its own end tag."""
        out, begun = {}, []
        for found in HIDDEN_TAG[name].finditer(source):
            if found[1]:
                if begun:
                    out[begun.pop()] = found.start()
            elif found[1] is not None:
                begun.append(found.start())
        return out

    def _end(self, stack: list[int], names: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in stops:
                return

    def text(self, keep) -> str:
        blocks, last, own = [], None, []
        for node, block, piece in self.texts:
            if not keep[node]:
                continue
            if block != last and own:
                blocks.append("".join(own))
                own = []
            last = block
            own.append(piece)
        if own:
            blocks.append("".join(own))
        return "\n".join(t for b in blocks if (t := " ".join(b.split())))

    def wrapper(self) -> list[bool]:
        return [t in ("#", "html", "body") for t in self.tags]

    def named(self) -> list[tuple[int, list[str]]]:
        """Elements with tokens of class, id, role and the like."""
        out = []
        for i, raw in enumerate(self.attrs):
            if raw and ("class" in raw or "id" in raw or "role" in raw or "itemprop" in raw or "=" in raw):
                words = [w for _, v in ATTRIBUTE.findall(raw) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v.strip("\"'")).lower()) if w]
                if words:
                    out.append((i, words))
        return out

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent, depth = np.array(self.parents), np.array(self.depths, dtype=np.float64)
        stats = np.zeros((n, 5))  # characters, stops, commas, upper case and digits, pieces of text
        for node, _, piece in self.texts:
            size = len(piece) - piece.count(" ")
            if size > 0:
                stats[node] += (size, piece.count(".") + piece.count("!") + piece.count("?"), piece.count(","), piece.count("/") + piece.count("|"), 1)
        group = np.array([GROUP_OF.get(t, len(GROUPS)) for t in self.tags])
        link = group == GROUP_OF["a"]
        whole = np.c_[stats, np.where(link, stats[:, 0], 0), np.ones(n), link, group == GROUP_OF["p"], group == GROUP_OF["li"]]
        inherited = np.zeros((n, 2 + BUCKETS))
        flags = np.zeros((n, len(GROUPS) + 1))
        flags[np.arange(n), group] = 1
        own = np.zeros((n, 2 + BUCKETS))
        for i, words in self.named():
            for w in words:
                k = TOKEN_OF.get(w)
                if k is None:
                    own[i, 2 + zlib.crc32(w.encode()) % BUCKETS] = 1
                else:
                    own[i, 0 if k < len(GOOD) else 1] = 1
        above = np.zeros((n, 6))  # article or main, nav, header or footer, aside, form, inside a link
        marks = np.c_[(group == 0) | (group == 1), group == 10, (group == 11) | (group == 12), group == 13, group == 14, link].astype(np.float64)
        for i in range(n - 1, 0, -1):
            whole[parent[i]] += whole[i]
        above[0], inherited[0] = marks[0], own[0]
        order, children = np.zeros(n), np.zeros(n)
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            above[i] = np.maximum(above[p], marks[i])
            inherited[i] = np.maximum(inherited[p], own[i])
            order[i] = children[p]
            children[p] += 1
            key = (p, self.tags[i])
            alike[key] = alike.get(key, 0) + 1
        same = np.array([alike.get((parent[i], self.tags[i]), 1) for i in range(n)], dtype=np.float64)
        chars, elements = whole[:, 0], whole[:, 6]
        total, up = max(1.0, chars[0]), whole[np.maximum(parent, 0)]
        return np.c_[flags, own[:, :2], inherited, above, depth, order, children, children[np.maximum(parent, 0)], same,
                     np.log1p(chars), np.log1p(stats[:, 0]), chars / total, chars / np.maximum(1, up[:, 0]), chars / elements,
                     whole[:, 5] / np.maximum(1, chars), (whole[:, 1] + whole[:, 2]) / np.maximum(1, chars), whole[:, 3] / np.maximum(1, chars),
                     whole[:, 7] / elements, whole[:, 8] / elements, whole[:, 9] / elements, np.log1p(elements), stats[:, 4], same / np.maximum(1, children[np.maximum(parent, 0)])]


def decoded(parents: list[int], margin: np.ndarray, wrapper: list[bool]) -> np.ndarray:
    """The most likely choice in which nothing is kept below a dropped element. Wrappers of a whole page are kept."""
    margin = np.where(np.array(wrapper), 50.0, margin)
    keep_cost, drop_cost = np.logaddexp(0, -margin), np.logaddexp(0, margin)
    keep, drop = keep_cost.tolist(), drop_cost.tolist()
    n = len(keep)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parents[i]
        keep[p] += min(keep[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        out[i] = keep[i] <= drop[i] if i == 0 else out[parents[i]] and keep[i] <= drop[i]
    return out


#: Builds of training pages: names of the sections by role. An empty name leaves a section out.
BUILDS = (
    {"main": "article", "nav": "nav", "head": "header", "foot": "footer", "side": "aside", "ad": 'div class="ad"', "note": 'div class="cookie-notice"',
     "talk": 'section class="comments"', "form": "form"},
    {"main": 'div class="article-body"', "nav": 'div class="menu"', "head": 'div id="header"', "foot": 'div id="footer"', "side": 'div class="sidebar"',
     "ad": 'div class="advert"', "note": 'div class="alert"', "talk": 'div id="comments"', "form": 'form class="newsletter"'},
    {"main": 'main class="content"', "nav": 'ul class="navigation"', "head": 'div class="banner"', "foot": 'div class="copyright"', "side": 'div id="side"',
     "ad": 'p class="sponsored"', "note": 'p class="notice"', "talk": 'ol class="comment-list"', "form": 'form id="search"'},
    {"main": 'section id="main-content"', "nav": 'div role="navigation"', "head": 'header class="masthead"', "foot": "footer", "side": 'aside class="related"',
     "ad": 'div class="promo"', "note": 'div role="alert" class="consent"', "talk": 'div class="reply-thread"', "form": 'div class="login"'},
    {"main": 'div class="post"', "nav": "nav", "head": "", "foot": 'div class="foot legal"', "side": 'div class="widget"', "ad": 'aside class="ad"',
     "note": "", "talk": 'aside class="comments"', "form": 'form action="/go"'},
    {"main": "article", "nav": "nav", "head": "", "foot": "footer", "side": "", "ad": 'div class="ad"', "note": "", "talk": "", "form": ""},
)


def training_pages(source: str, seed: int) -> list[str]:
    """A page put together anew in every build; elements of the main text carry the attribute ``data-kept``."""
    page, rng = Page(source), np.random.default_rng(seed)
    role = {}
    for i, tag in enumerate(page.tags):
        role[i] = ("main" if tag in ("article", "main") else "nav" if tag == "nav" else "other" if tag in ("footer", "header", "aside", "form") or "ad" in page.attrs[i]
                   else role.get(page.parents[i], "none"))
    texts: dict[str, list[str]] = {"main": [], "nav": [], "other": []}
    last = None
    for node, block, piece in page.texts:
        if role[node] in texts and (piece := " ".join(piece.split())):
            if (block, role[node]) == last:
                texts[role[node]][-1] += " " + piece
            else:
                texts[role[node]].append(piece)
            last = (block, role[node])
    if not texts["main"]:
        return []
    esc = html.escape
    words = (" ".join(texts["other"] + texts["main"][-2:]) or "all rights reserved").split()

    def some(n: int) -> str:
        n = n * int(rng.choice([1, 1, 2, 6]))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return esc(" ".join(words[at:at + n]))

    def inside(name: str, body: str, kept: bool = False) -> str:
        return f"<{name}{' data-kept' if kept else ''}>{body}</{name.split()[0]}>" if name else ""

    out = []
    for b in BUILDS:
        links = "".join(f'<li><a href="/{k}">{esc(t)}</a></li>' for k, t in enumerate(texts["nav"] or ["home", "about"]))
        body, lines = [], texts["main"]
        short = rng.random() < 0.5  # so that the amount of text alone does not tell
        if short:
            lines = lines[:int(rng.integers(1, 5))]
        for k, t in enumerate(lines):
            if short and rng.random() < 0.7:
                t = " ".join(t.split()[:int(rng.integers(2, 15))])
            kind = "h1" if k == 0 else rng.choice(["p", "p", "p", "p", "h2", "blockquote", "li"])
            bold = rng.random() < 0.2
            body.append((f"<{kind} data-kept>" + ("<b data-kept>" if bold else "")) + esc(t) + ("<br>" if bold else f"</{kind}>"))
            if rng.random() < 0.06:
                body.append(inside(b["ad"], some(8)))
        talk = "".join(f'<div class="comment"><span class="author">{some(2)}</span><p>{some(int(rng.integers(5, 40)))}</p></div>' for _ in range(3))
        parts = [inside(b["note"], some(12)), inside(b["head"], f"<a href='/'>{some(2)}</a>" + some(4)),
                 inside(b["nav"], links if b["nav"].startswith("ul") else f"<ul>{links}</ul>"), inside(b["ad"], some(9)),
                 inside(b["main"], "".join(body), kept=True), inside(b["side"], f"<h3>{some(2)}</h3><ul>{links}</ul><p>{some(14)}</p>"),
                 inside(b["form"], f"<label>{some(2)}</label><input name=q>"), inside(b["talk"], talk), inside(b["foot"], "&copy; " + some(10))]
        wrap = rng.random() < 0.5
        out.append("<!DOCTYPE html><html data-kept><head><title>t</title></head><body data-kept>" + ("<div class='wrapper' data-kept>" if wrap else "")
                   + "".join(parts) + ("</div>" if wrap else "") + "</body></html>")
    return out


def learn(pages: DataFrame, *, sample: int = SAMPLE, id: str = "page_id", html: str = "html") -> dict:
    """Boosted trees from about ``sample`` pages, picked by a hash of the id over all pages; plain data."""
    own = pages.select(F.col(id).alias("id"), F.col(html).alias("html")).filter(F.length("html") > 0)
    n = own.count()
    drawn = own.filter(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, kept = [], []
            for source in batch.column("html").to_pylist():
                for made in training_pages(source, zlib.crc32(source.encode())):
                    page = Page(made)
                    rows.extend(page.features().astype(np.float32))
                    kept.extend(i == 0 or "data-kept" in a for i, a in enumerate(page.attrs))
            return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(kept, pa.bool_())], names=["x", "kept"])
        return run

    rows = sorted((bytes(r.x), r.kept) for r in emit(drawn, "html", "x binary, kept boolean", make).collect())
    if not rows:
        return {}
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], dtype=np.float64)
    return trees.fit(x, np.array([1.0 if r[1] else 0.0 for r in rows]), np.ones(len(rows)))


def extract(pages: DataFrame, model: dict, *, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with a column ``out``: the main text, one line for each block."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        known = trees.Boosted(shared.value) if shared.value else None

        def run(sources: pa.Array) -> pa.Array:
            read = [Page(s or "") for s in sources.to_pylist()]
            if known is None:
                return pa.array([p.text(np.ones(len(p.tags), dtype=bool)) for p in read], pa.string())
            some, first = [p.features() for p in read], np.r_[0, np.cumsum([len(p.tags) for p in read])]
            margin = known.margin(np.concatenate(some))
            return pa.array([p.text(decoded(p.parents, margin[a:b], p.wrapper())) for p, a, b in zip(read, first[:-1], first[1:], strict=True)], pa.string())
        return run

    return attach(pages, html, out, "string", make)
