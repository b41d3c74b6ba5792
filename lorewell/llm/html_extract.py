"""Main text of web pages by tag-path ratios.

A tolerant scan turns a page into block elements and runs of text. Runs are grouped by their tag path: the tags, first
classes and ids (without digits) from the root down. A path's text ratio (letters outside links for each run) and its punctuation ratio
are given to its runs, smoothed along the page and multiplied; a path's score is the mean of that over its runs, and paths whose score reaches the threshold are
chosen. All text of the chosen paths stays, wherever it stands, and nothing else but what no name weighs down and either is in an article or main element
that holds such text, or between two runs of it in one block, or is a heading in the innermost block around all of it, or right above it. Lists of links stay in such an element from its text
on, and between the text of a block; elsewhere they are menus.

Tags and roles of navigation, dialogs, scripts and the like take no part. A class or id (or a form tag) that names a block as sidebar, notice, advert, comment
and the like weighs on its paths' scores, no more; and it weighs only if the blocks with that name hold less than most of the chosen text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import lean, small_batches

#: Weights of a run's neighbours at distance 0, 1, 2.
KERNEL = (0.5, 0.2, 0.05)
#: A path is chosen from this many deviations of the runs' scores on, and from this share of their mean.
THRESHOLD, SHARE = 0.5, 0.4
#: What a name of layout, and a name of what others have written, leave of a path's score.
NAMED, FOREIGN = 0.05, 0.02
#: The same while it is told which names hold most of the text.
NAMED_FIRST, FOREIGN_FIRST = 0.5, 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody thead tfoot table figcaption caption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOUND = frozenset("html body article section main div td th table li blockquote nav aside footer header form figure dd".split())
#: What an opening tag ends if it is open, up to a tag that bounds it; by kind of the opening tag.
_ENDS = (
    (frozenset({"p"}), _BOUND), (_HEADING | {"p"}, _BOUND), (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), (frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"table"})), (frozenset({"td", "th"}), frozenset({"tr", "table"})), (frozenset({"option"}), frozenset({"select"})),
)
_KIND = dict.fromkeys(_HEADING, 1) | {"li": 2, "dt": 3, "dd": 3, "tr": 4, "td": 5, "th": 5, "option": 6}
_TURNS = frozenset().union(*(ends | bounds for ends, bounds in _ENDS))
_NEVER = frozenset("head nav footer aside script style noscript template button select option textarea dialog iframe object svg canvas audio video menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
#: Words of classes and ids that name what is not the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer footers header headers masthead topbar comment comments disqus reply replies respond discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar widget widgets pagination pager paywall copyright form toc hidden".split()
)
#: Of these, words that name parts of an article too.
_ALONE = frozenset("header headers form rail notice notices alert discussion search social navigation promotion copyright".split())
_TALK = frozenset("comment comments disqus reply replies respond".split())
_FOREIGN = _TALK | frozenset("discussion ad ads adv advert adverts advertisement adsense cookie cookies consent gdpr newsletter paywall".split())
_ARTICLE_WORDS = frozenset({"comment", "comments", "reply", "related", "ad", "promo"})
_FORM = "<form>"
_MARKS = re.compile(r"[.,;:!?…、。，！？]")
_STATE = re.compile(r"(?<!\S)(?:has|with|without|no)(?:[-_]|(?=[A-Z]))\S+")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"[\s ]+")


@lru_cache(4096)
def _names(classes: str) -> frozenset:
    """The words of a class or id; what a block has or lacks (has-sidebar, no-sidebar) doesn't name it."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", _STATE.sub("", classes))
    return frozenset(re.findall(r"[a-z]+", spaced.lower()))


class _Page:
    """Block elements (parent, tag, number of the tag path, whether they are no part of an article, words that name them as none) and runs of text (element, text, letters in links)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.path, self.bad, self.word, within_of = [-1], [""], [0], [False], [frozenset()], [False]
        self.runs: list[tuple[int, str, int]] = []
        paths: dict[tuple, int] = {}
        # Open elements: number, tag, and for each kind of _ENDS the place of what an opening tag of that kind would end, or 0.
        stack: list[tuple[int, str, tuple]] = [(0, "", (0,) * len(_ENDS))]
        open_: dict[str, int] = {}
        links = 0
        text: list[str] = []
        linked = 0

        def close() -> None:
            nonlocal linked
            if text:
                whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                if whole:
                    self.runs.append((stack[-1][0], whole, linked))
                text.clear()
                linked = 0

        def cut(i: int) -> None:
            for _, t, _ in stack[i:]:
                open_[t] -= 1
            del stack[i:]

        at, n = 0, len(source)
        while at < n:
            mark = source.find("<", at)
            if mark < 0:
                mark = n
            if mark > at:
                piece = source[at:mark]
                text.append(piece)
                if links:
                    linked += len(piece)
            if mark == n:
                break
            m = _TOKEN.match(source, mark)
            if not m:
                text.append("<")
                at = mark + 1
                continue
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag not in _INLINE and open_.get(tag):
                    close()
                    i = len(stack) - 1
                    while stack[i][1] != tag:
                        i -= 1
                    cut(i)
                    links = 0
                continue
            if tag == "br":
                text.append(" ")
            if tag == "a":
                links += 1
            if tag in _RAW:
                end = _RAW_END[tag].search(source, at)
                end = end.start() if end else n
                close()
                at = n if (gt := source.find(">", end)) < 0 else gt + 1
                continue
            if tag in _INLINE:
                continue
            close()
            if tag in _VOID:
                continue
            if i := stack[-1][2][_KIND.get(tag, 0)]:
                cut(i)
            links = 0
            up = stack[-1][0]
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m[3])} if m[3].strip(" \t\r\n/") else {}
            within = within_of[up]
            bad = tag in _NEVER or (tag == "header" and not within) or attrs.get("role", "") in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            bad = bad or re.sub(r"\s", "", attrs.get("style", "")).find("display:none") >= 0
            word = self._words(tag, attrs, within) if attrs or tag == "form" else frozenset()
            first = attrs.get("class", "").split()[:1]
            step = (self.path[up], tag, first[0] if first else "", _DIGITS.sub("", attrs.get("id", "")), word)
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(paths.setdefault(step, len(paths) + 1))
            self.bad.append(bad)
            self.word.append(word)
            within_of.append(within or tag in ("article", "main"))
            if not m[3].endswith("/") or tag in _BOUND or tag == "p":
                near = stack[-1][2]
                if tag in _TURNS:
                    place = len(stack)
                    near = tuple(place if tag in ends else 0 if tag in bounds else was for (ends, bounds), was in zip(_ENDS, near, strict=True))
                stack.append((len(self.tag) - 1, tag, near))
                open_[tag] = open_.get(tag, 0) + 1
        close()

    @staticmethod
    def _words(tag: str, attrs: dict, within: bool) -> frozenset:
        form = frozenset({_FORM}) if tag == "form" or attrs.get("role", "") == "form" else frozenset()
        if tag in ("html", "body", "main") or tag in _HEADING:
            return form
        own, anchor = _names(attrs.get("class", "")), attrs.get("id", "")
        if within and (tag == "section" or "section" in own):
            # The id of an article's section is made of its title.
            own |= _TALK & {anchor}
        else:
            own |= _names(anchor)
        if tag == "article":
            return form | own & _ARTICLE_WORDS
        return form | own & (_WORDS - _ALONE if within else _WORDS)


def _smooth(x: np.ndarray) -> np.ndarray:
    out, total = KERNEL[0] * x, np.full(len(x), KERNEL[0])
    for d in range(1, min(len(KERNEL), len(x))):
        out[d:] += KERNEL[d] * x[:-d]
        out[:-d] += KERNEL[d] * x[d:]
        total[d:] += KERNEL[d]
        total[:-d] += KERNEL[d]
    return out / total


def _ratios(page: _Page, runs: list, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: the number of its tag path, its letters outside links, and whether its path is chosen."""
    plain = np.array([max(0, len(t) - linked) for _, t, linked in runs], dtype=float)
    marks = np.array([len(_MARKS.findall(t)) for _, t, _ in runs], dtype=float) * (plain > 0)
    _, group = np.unique([page.path[e] for e, _, _ in runs], return_inverse=True)
    count = np.bincount(group)
    length, point = (np.bincount(group, weights=x) / count for x in (plain, marks))
    fused = _smooth(length[group]) * _smooth(1 + point[group]) * weight
    score = np.bincount(group, weights=fused) / count
    bar = max(THRESHOLD * fused.std(), SHARE * fused.mean())
    return group, plain, (score >= min(bar, score.max()))[group] & (length[group] > 0)


def _weights(page: _Page, words: list[frozenset], gone: list[bool]) -> list[float]:
    """What names leave of each block's score. Blocks of one name and depth (how many blocks of that name they are in) aren't weighed down if they hold most of
    the text that is chosen at first; if what is left were less than half of it, names of layout are no evidence on this page. What others have written counts little."""
    n = len(page.tag)
    runs = [r for r in page.runs if not gone[r[0]]]
    # Names go down as links to the enclosing named block, so that nesting costs nothing: number of the block's chain -> (outer chain, names with depth).
    chain, chains, depth_of = [0] * n, [(0, ())], [{}]
    weight, share = np.ones(n), np.ones(n)
    for e in range(1, n):
        up = page.parent[e]
        chain[e], weight[e], share[e] = chain[up], weight[up], share[up]
        if words[e]:
            have = depth_of[chain[up]]
            own = tuple((w, have.get(w, 0)) for w in sorted(words[e]))
            chains.append((chain[up], own))
            depth_of.append(have | {w: d + 1 for w, d in own})
            chain[e] = len(chains) - 1
            foreign = bool(words[e] & _FOREIGN)
            weight[e] *= FOREIGN_FIRST if foreign else NAMED_FIRST
            share[e] *= FOREIGN_FIRST if foreign else 1.0
    if not any(chain[e] for e, _, _ in runs):
        return [1.0] * n
    at = np.array([e for e, _, _ in runs])
    _, plain, chosen = _ratios(page, runs, weight[at])
    mass = plain * chosen * share[at]
    half = mass.sum() / 2
    inner = np.bincount([chain[e] for e in at], weights=mass, minlength=len(chains))
    held: dict[tuple, float] = {}
    for c in range(len(chains) - 1, 0, -1):  # inner chains come after outer ones
        inner[chains[c][0]] += inner[c]
        for name in chains[c][1]:
            held[name] = held.get(name, 0.0) + inner[c]

    def down(believed: frozenset | None) -> list[float]:
        left = [1.0] * len(chains)
        for c in range(1, len(chains)):
            own = [name for name, _ in (x for x in chains[c][1] if held.get(x, 0.0) <= half and (believed is None or x[0] in believed))]
            left[c] = left[chains[c][0]] * ((FOREIGN if any(w in _FOREIGN for w in own) else NAMED) if own else 1.0)
        return [left[c] for c in chain]

    out = down(None)
    return out if sum(x for e, x in zip(at, mass, strict=True) if out[e] == 1.0) >= half else down(_FOREIGN)


def main_text(source: str) -> str:
    """The article's blocks, joined by line ends; empty if there is no text that may be one. Time and memory grow in proportion to the page, however deep its tags are nested."""
    page = _Page(source)
    n = len(page.tag)
    holds = [t in ("article", "main") for t in page.tag]
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    gone = [False] * n
    for e in range(1, n):
        gone[e] = gone[page.parent[e]] or page.bad[e]
    weight = _weights(page, [w if t == "article" or not h else frozenset() for w, t, h in zip(page.word, page.tag, holds, strict=True)], gone)
    runs = [r for r in page.runs if not gone[r[0]]]
    if not runs:
        return ""
    group, _, chosen = _ratios(page, runs, np.array([weight[e] for e, _, _ in runs]))
    if not chosen.any():
        return ""
    # The innermost block around all chosen runs, and the elements that are marked as an article and hold some of them.
    held = np.zeros(n, dtype=int)
    for (e, _, _), c in zip(runs, chosen, strict=True):
        held[e] += c
    for e in range(n - 1, 0, -1):
        held[page.parent[e]] += held[e]
    top = max(e for e in range(n) if held[e] == held[0] and page.tag[e] not in _LEAF)
    inside, marked, block = [False] * n, [False] * n, [0] * n
    inside[top] = True
    for e in range(1, n):
        inside[e] = inside[e] or inside[page.parent[e]]
        block[e] = block[page.parent[e]] if page.tag[e] in _LEAF else e
        marked[e] = marked[page.parent[e]] or (page.tag[e] in ("article", "main") and held[e] > 0)
    with_text = {block[e] for (e, _, _), c in zip(runs, chosen, strict=True) if c}
    first, last = np.flatnonzero(chosen)[[0, -1]]
    out = []
    above = False
    for i in range(len(runs) - 1, -1, -1):
        e, text, linked = runs[i]
        # Links alone are a menu, but not in an article from where its text begins on, nor between the text of a block: there they are references and the like.
        between = first < i < last and block[e] in with_text
        menu = linked >= 0.9 * len(text) and page.tag[e] in ("li", "ul", "ol", "div", "section") and not (marked[e] and i > first) and not between
        free = weight[e] == 1.0
        heading = page.tag[e] in _HEADING and i < last and (inside[e] or above)
        keep = not menu and (chosen[i] or (free and (marked[e] or heading or between)))
        above = keep and (above or chosen[i])
        if keep:
            out.append(text)
    out.reverse()
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html). A null or empty html
    gives an empty text. Rows may repeat; other columns are not read."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return own.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
