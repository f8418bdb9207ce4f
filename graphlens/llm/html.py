"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with their elements. A linear classifier over structural
features gives each block a cost of being content and a cost of being boilerplate, which are the
capacities of its edges to the two terminals. Neighbouring blocks, and blocks near to each other in
the element tree, are joined by smoothness edges. A maximum flow separates the two sides; the
blocks on the source side are the article.

A null html counts as empty; a page without blocks has the empty text. Broken, unclosed and cut-off
markup is read like a browser would: unclosed paragraphs end at the next block. Pages of any length
and depth are read whole, in about linear time. Rows are handled one by one, so repeated pages and
ids do not matter. Other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import table

# Elements by their part in a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p
    pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("""audio button canvas datalist head iframe map math noscript object option select style svg
    template textarea title video script""".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
BAD_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
BAD_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs
    comment comments cookie cookies consent copyright disclaimer disqus dropdown feedback footer gdpr hidden
    login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination
    paywall popup privacy promo promoted promotion recommended register related reply replies responses search
    share sharing shoutbox sidebar sidebars signup social sponsor sponsored subscribe subscription tags teaser
    toolbar topbar widget widgets""".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Words that name a part of a page beside one of the words above, as in sidebar-left or comment-list.
PARTS = frozenset("""area article articles bar block blog body bottom box btn button buttons col column container content entry feed
    form global group head header icon icons inline inner item items js left link links list main module outer page panel post posts
    primary region right row secondary section site slot small space text the thread title top unit user wrap wrapper""".split())
#: First words of a label that says what an element has or lacks, and last words of one that says how it is.
DESCRIBING = frozenset("has have with without no not non is are hide hides show shows".split())
STATES = frozenset("active allowed closed collapsed disabled enabled free less off on open ready visible".split())
#: Elements that frame a whole page, whose labels describe its layout.
FRAME = frozenset("html body main article".split())
#: A label does not count against an element with at least this share of the text if less than so many characters, and less than a
#: tenth of the page, are left without any cue.
MOST, LITTLE = 0.5, 200

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
#: Of a tag, up to its end or through one quoted value.
_PART = re.compile(r"""[^>"']*+(?:(>)|"[^"]*+"|'[^']*+')""")
_CUE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/>]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
#: Between the words of a name in camel case.
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _rest(page: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose name ends at ``at``: at the first > outside quoted values, or if there is
    none, at the first one. ``dead`` holds places after quoted values from which none is found, so
    that no part of a page is read over and over."""
    seen, p = [], at
    while p not in dead:
        m = _PART.match(page, p)
        if not m:
            break
        p = m.end()
        if m[1]:
            return p
        seen.append(p)
    dead.update(seen)
    end = page.find(">", at)
    return end + 1 if end >= 0 else len(page)


class Block:
    """A run of text between block boundaries: its text, link share and place among the elements.

    ``leaf`` and ``parent`` number its element and the one around that (0 for none), ``depth`` counts the
    elements around the text, ``shared`` those that it has in common with the block before."""

    __slots__ = ("text", "linked", "leaf", "parent", "depth", "shared", "bad", "good", "tag", "label")

    def __init__(self, text: str, linked: int, leaf: int, parent: int, depth: int, shared: int, bad: int, good: int, tag: str, label: int = 0) -> None:
        self.text, self.linked, self.leaf, self.parent, self.depth, self.shared = text, linked, leaf, parent, depth, shared
        self.bad, self.good, self.tag, self.label = bad, good, tag, label


def _names(attrs: str) -> Iterator[list[str]]:
    """The words of each of an element's labels; ``with-sidebar`` is one label of two words."""
    if "=" in attrs:
        for found in _CUE.finditer(attrs):
            for label in _HUMP.sub("-", found[1] or found[2] or found[3] or "").split():
                yield _NAME.findall(label.lower())


def _speaks_against(words: list[str]) -> bool:
    """Whether a label says what an element is. One that says what the element has, lacks or does (has-sidebar,
    no-ads, comments-open, overflow-hidden, social-studies) only describes it."""
    if not words or words[0] in DESCRIBING or words[-1] in STATES:
        return False
    known = [w in BAD_WORDS or w.isdigit() or w in PARTS for w in words]
    return any(w in BAD_WORDS for w in words) and (len(words) == 1 or all(known))


def _cues(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element's name or a hidden state speaks against content, whether its labels do, and whether either speaks for it.
    Labels of the page's own frame (html, body, main, article) say nothing against it."""
    bad = tag in BAD_TAGS or (tag == "header" and not in_article)
    good, labelled = tag in ("article", "main"), False
    for words in _names(attrs):
        labelled = labelled or (tag not in FRAME and _speaks_against(words))
        good = good or any(n in GOOD_WORDS for n in words)
    if attrs and _HIDDEN.search(attrs):
        bad = True
    return bad, labelled and not bad, good and not bad and not labelled


def blocks(html: str | None) -> list[Block]:
    """All blocks with text, in page order."""
    page, out = html or "", []
    # Name, number, bad and good cues so far, in an article, nearest element whose label speaks against it.
    stack: list[tuple[str, int, int, int, bool, int]] = []
    labels = [0]  # for each element with such a label the one around it
    pairs: dict[str, dict[int, int]] = {}
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    number, linked, in_link, at, last = 0, 0, 0, 0, len(page)
    low = 0  # least depth since the last block

    def flush() -> None:
        nonlocal linked, low
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                bad, good, tag, label = (stack[-1][2], stack[-1][3], stack[-1][0], stack[-1][5]) if stack else (0, 0, "", 0)
                leaf, parent = stack[-1][1] if stack else 0, stack[-2][1] if len(stack) > 1 else 0
                out.append(Block(text, min(linked, len(text)), leaf, parent, len(stack), low, bad, good, tag, label))
                low = len(stack)
            buffer.clear()
        linked = 0

    def said(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece) if "&" in piece else piece
        buffer.append(piece)
        if in_link:
            linked += len(piece.strip())

    def close(name: str, scope: set[str] | None = None) -> None:
        nonlocal low
        for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
            if stack[i][0] == name:
                opened.subtract(s[0] for s in stack[i:])
                del stack[i:]
                low = min(low, i)
                return
            if scope and stack[i][0] in scope:
                return

    dead: set[int] = set()
    while at < last:
        m = _MARKUP.search(page, at)
        if not m:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        at, attrs = (end := _rest(page, at, dead)), page[m.end() : end]
        name, ends = m[2].lower(), bool(m[1])
        if name in SKIPPED:
            if not ends and not attrs.endswith("/>"):
                at = _skip(page, m.start(), at, name, pairs)
            elif ends:
                continue
            buffer.append(" ")
        elif name == "br":
            buffer.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        elif name in BLOCKS:
            flush()
            in_link = 0
            if ends:
                close(name)
                continue
            close("p", {"td", "th", "table", "button"})
            for other in CLOSES.get(name, ()):
                close(other, SCOPES[name])
            if name in VOID:
                continue
            number += 1
            was = stack[-1] if stack else ("", 0, 0, 0, False, 0)
            bad, labelled, good = _cues(name, attrs, was[4])
            if labelled:
                labels.append(was[5])
            stack.append((name, number, was[2] + bad, was[3] + good, was[4] or name in ("article", "main"), len(labels) - 1 if labelled else was[5]))
            opened[name] += 1
    flush()
    _weigh_labels(out, labels)
    return out


def _weigh_labels(found: list[Block], labels: list[int]) -> None:
    """Adds to each block's bad cues the labels around it that count: not those of an element with most of a page that would
    lose nearly all of its text by them."""
    below, total = [0] * len(labels), sum(len(b.text) for b in found)
    for b in found:
        below[b.label] += len(b.text)
    for i in range(len(labels) - 1, 0, -1):
        below[labels[i]] += below[i]
    free = sum(len(b.text) for b in found if not b.bad and not b.label)
    spare = free < LITTLE and 10 * free < total
    counted = [0] * len(labels)
    for i in range(1, len(labels)):
        counted[i] = counted[labels[i]] + (not (spare and below[i] >= MOST * total))
    for b in found:
        b.bad += counted[b.label]


def _closes(page: str, name: str) -> dict[int, int]:
    """Where each element of a name that is closed ends, by the place of its start tag, in one pass over the page."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){name}\b[^>]*>", page, re.I):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def _skip(page: str, start: int, at: int, name: str, pairs: dict[str, dict[int, int]]) -> int:
    """The end of a skipped element whose tag is at start and ends at ``at``. One that is never closed and holds no raw text may
    stay open; else it goes on to the end of the page. ``pairs`` keeps what has been found for a name."""
    if name in RAW:
        m = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
        return m.end() if m else len(page)
    if name not in pairs:
        pairs[name] = _closes(page, name)
    end = pairs[name].get(start, -1)
    if end >= at:
        return end
    if name == "head":
        m = re.compile(r"<body\b", re.I).search(page, at)
        return m.start() if m else at
    return at


def score(b: Block) -> float:
    """Log odds of a block being content."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    z = 0.2 + min(words, 40) / 20 + (0.5 if b.text[-1] in ".!?:;…”\"" else 0.0)
    z += 3.0 * min(b.good, 2) - 9.0 * min(b.bad, 2)
    z -= 3.0 * b.linked / n
    if b.tag in ("p", "pre", "blockquote") or (b.tag[:1] == "h" and b.tag[1:].isdigit()):
        z += 0.7
    elif b.tag == "li" and b.linked * 2 > n:
        z -= 2.0
    if "©" in b.text or "all rights reserved" in b.text.lower():
        z -= 4.0
    return z


SMOOTH, NEAR = 1.0, 8


def smoothness(a: Block, b: Block) -> float:
    """Capacity between two blocks that follow each other or have the same parent: high for neighbours in the
    element tree, low across a cue."""
    common = a.depth if a.leaf == b.leaf else max(0, min(a.depth, b.depth) - (a.depth == b.depth)) if a.parent == b.parent else b.shared
    apart = a.depth + b.depth - 2 * common
    return SMOOTH / (1 + apart / 2) * (0.05 if (a.bad > 0) != (b.bad > 0) else 1.0)


def neighbours(found: list[Block]) -> list[tuple[int, int]]:
    """Each block with the next one, and with the next one of the same parent within NEAR places."""
    n, last, out = len(found), {}, [(i, i + 1) for i in range(len(found) - 1)]
    for j in range(n - 1, -1, -1):
        parent = found[j].parent
        # The nearest block of this parent that is not the very next one.
        for k in last.get(parent, ()):
            if k > j + 1:
                if k < j + NEAR:
                    out.append((j, k))
                break
        last[parent] = (j, *last.get(parent, ())[:1])
    return out


EPS = 1e-9


class _Flow:
    """Flow from blocks with positive pull to those with negative pull. What a block's pull can give to the
    opposite terminal is taken off before, so each has an edge to one terminal."""

    def __init__(self, pull: list[float], edges: list[tuple[int, int, float]]) -> None:
        self.pull, self.residual = pull, [{} for _ in pull]
        for i, j, c in edges:
            self.residual[i][j] = self.residual[i].get(j, 0.0) + c
            self.residual[j][i] = self.residual[j].get(i, 0.0) + c

    def settle(self) -> None:
        """A block that pulls harder than all its edges can carry lies on the side of its pull in every minimum cut.
        Its edges are filled, or handed over as pull, and it leaves the graph."""
        pull, residual = self.pull, self.residual
        load = [sum(r.values()) for r in residual]
        open_ = [i for i in range(len(pull)) if residual[i] and abs(pull[i]) >= load[i]]
        while open_:
            i = open_.pop()
            if not residual[i] or abs(pull[i]) < load[i]:
                continue
            sign = 1.0 if pull[i] > 0 else -1.0
            for j, c in residual[i].items():
                del residual[j][i]
                load[j] -= c
                pull[j] += sign * c
                if residual[j] and abs(pull[j]) >= load[j]:
                    open_.append(j)
            residual[i], load[i] = {}, 0.0

    def run(self) -> set[int]:
        """Pushes a maximum flow, part by part of the graph; gives the blocks on the source side."""
        side, seen = set(), set()
        for start in range(len(self.pull)):
            if start not in seen:
                part, rest = [start], [start]
                seen.add(start)
                while rest:
                    for j in self.residual[rest.pop()]:
                        if j not in seen:
                            seen.add(j)
                            part.append(j)
                            rest.append(j)
                side |= self._maximum(part)
        return side

    def _maximum(self, part: list[int]) -> set[int]:
        """Dinic's phases in one part: levels from all blocks with supply, then augmenting paths along the levels."""
        pull, residual = self.pull, self.residual
        while True:
            now = [i for i in part if pull[i] > EPS]
            level, goal = dict.fromkeys(now, 0), False
            depth = 0
            while now and not goal:
                depth += 1
                after = []
                for i in now:
                    for j, c in residual[i].items():
                        if c > EPS and j not in level:
                            level[j] = depth
                            after.append(j)
                            goal = goal or pull[j] < -EPS
                now = after
            if not goal:
                return set(level)
            arcs = {i: [j for j, c in residual[i].items() if c > EPS and level.get(j) == level[i] + 1] for i in level if level[i] < depth}
            turn = dict.fromkeys(arcs, 0)
            for source in [i for i, d in level.items() if d == 0]:
                path = [source]
                while path and pull[source] > EPS:
                    i = path[-1]
                    if pull[i] < -EPS:
                        flow, cut = min(pull[source], -pull[i], *(residual[x][y] for x, y in zip(path, path[1:], strict=False))), 0
                        for k, (x, y) in enumerate(zip(path, path[1:], strict=False)):
                            residual[x][y] -= flow
                            residual[y][x] += flow
                            if residual[x][y] <= EPS and not cut:
                                cut = k + 1
                        pull[source] -= flow
                        pull[i] += flow
                        # On from where the path broke; from before its end if that is filled.
                        del path[cut or len(path) - (pull[i] >= -EPS) :]
                        continue
                    own, k = arcs.get(i, ()), turn.get(i, 0)
                    while k < len(own) and residual[i][own[k]] <= EPS:
                        k += 1
                    if k < len(own):
                        turn[i] = k
                        path.append(own[k])
                        continue
                    if own:
                        turn[i] = k
                    path.pop()
                    if path:
                        turn[path[-1]] += 1


def content(found: list[Block]) -> list[bool]:
    """For each block whether it falls on the content side of a minimum cut. The terminal capacities are the
    costs of the labels, log(1 + e**z) for boilerplate and log(1 + e**-z) for content; the smaller of both flows
    straight through, which leaves one terminal edge, of capacity |z|."""
    flow = _Flow([score(b) for b in found], [(i, j, smoothness(found[i], found[j])) for i, j in neighbours(found)])
    flow.settle()
    kept = flow.run()
    return [i in kept for i in range(len(found))]


def main_text(html: str | None) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, kept in zip(found, content(found), strict=True) if kept)


@F.pandas_udf(T.StringType())
def main_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield pd.Series([main_text(p) for p in s], index=s.index, dtype=object)


def extracted(pages: DataFrame) -> DataFrame:
    """row (struct of the input's columns), text."""
    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), main_text_udf("html").alias("text"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
