"""Page extraction against a plain version that follows the documentation, and what the ratios decide."""

import re
import statistics
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest

from lorewell.llm import html_extract as H
from lorewell.llm.html_extract import main_text


class _Tree(HTMLParser):
    """Blocks as [parent, tag, attributes] and runs as [block, text, letters in links] of tidy pages: a <p> may stay open."""

    def __init__(self, source):
        super().__init__()
        self.blocks, self.open, self.runs, self.parts, self.linked, self.link, self.raw = [[None, "", {}]], [0], [], [], 0, False, False
        self.feed(source)
        self.flush()

    def flush(self):
        text = re.sub(r"[\s ]+", " ", "".join(self.parts)).strip()
        if text:
            self.runs.append([self.open[-1], text, self.linked])
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "em", "a", "span", "br"):
            self.link = self.link or tag == "a"
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        self.raw = tag in ("script", "style", "title")
        if self.raw or tag in ("meta", "input"):
            return
        if self.blocks[self.open[-1]][1] == "p":
            self.open.pop()
        self.blocks.append([self.open[-1], tag, dict(attrs)])
        self.open.append(len(self.blocks) - 1)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        if tag in ("script", "style", "title"):
            self.raw = False
            return
        if tag in [self.blocks[e][1] for e in self.open]:
            self.flush()
            while self.blocks[self.open.pop()][1] != tag:
                pass

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)
            self.linked += len(data) if self.link else 0


def _plain(source):
    """The documented rules, one loop after the other, for pages whose classes are single known words."""
    tree = _Tree(source)
    up = lambda e: [] if e is None else [e, *up(tree.blocks[e][0])]
    tag, cls = lambda e: tree.blocks[e][1], lambda e: tree.blocks[e][2].get("class", "")
    runs = [r for r in tree.runs if not any(tag(e) in ("nav", "footer", "aside") or (tag(e) == "header" and "article" not in map(tag, up(e))) for e in up(r[0]))]
    if not runs:
        return ""
    key = [tuple((tag(e), cls(e), tree.blocks[e][2].get("id", "")) for e in up(r[0])) for r in runs]
    names = [{cls(e) for e in up(r[0])} & {"ad", "comments", "sidebar"} for r in runs]

    def smooth(x):
        out = []
        for i in range(len(x)):
            near = [(H.KERNEL[abs(i - j)], x[j]) for j in range(len(x)) if abs(i - j) < len(H.KERNEL)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    def ratios(weight):
        letters = [max(0, len(t) - k) for _, t, k in runs]
        marks = [len(re.findall(r"[.,;:!?…、。，！？]", t)) if n else 0 for (_, t, _), n in zip(runs, letters, strict=True)]
        mean = lambda x, k: statistics.fmean(v for v, own in zip(x, key, strict=True) if own == k)
        length = [mean(letters, k) for k in key]
        fused = [a * b * w for a, b, w in zip(smooth(length), smooth([1 + mean(marks, k) for k in key]), weight, strict=True)]
        score = [mean(fused, k) for k in key]
        bar = min(max(score), max(H.THRESHOLD * statistics.pstdev(fused), H.SHARE * statistics.fmean(fused)))
        return letters, [s >= bar * (1 - 1e-12) and n > 0 for s, n in zip(score, length, strict=True)]

    first = [float(np.prod([H.NAMED_FIRST if n == "sidebar" else H.FOREIGN_FIRST for n in own])) for own in names]
    letters, chosen = ratios(first)
    mass = [n * c * (H.FOREIGN_FIRST if own - {"sidebar"} else 1) for n, c, own in zip(letters, chosen, names, strict=True)]
    believed = {n for n in ("ad", "comments", "sidebar") if sum(m for m, own in zip(mass, names, strict=True) if n in own) <= sum(mass) / 2}
    weight = [float(np.prod([H.NAMED if n == "sidebar" else H.FOREIGN for n in own & believed])) for own in names]
    _, chosen = ratios(weight)
    articles = {e for (b, _, _), c in zip(runs, chosen, strict=True) if c for e in up(b) if tag(e) in ("article", "main")}
    leaf = lambda e: tag(e) in ("p", "h1", "h2", "ul", "li", "blockquote", "td", "tr", "table")
    block = lambda e: next(x for x in up(e) if not leaf(x))
    blocks = {block(b) for (b, _, _), c in zip(runs, chosen, strict=True) if c}
    around = [e for e in range(len(tree.blocks)) if not leaf(e) and all(e in up(b) for (b, _, _), c in zip(runs, chosen, strict=True) if c)]
    out, above = [], False
    for i in reversed(range(len(runs))):
        (b, text, linked), c, w = runs[i], chosen[i], weight[i]
        before, later = any(chosen[:i]), any(chosen[i + 1 :])
        heading = tag(b) in ("h1", "h2") and later and (max(around) in up(b) or above)
        between = before and later and block(b) in blocks
        keep = c or (w == 1 and (heading or articles & set(up(b)) or between))
        keep = keep and not (linked >= 0.9 * len(text) and tag(b) in ("li", "ul", "div") and not between and not (before and articles & set(up(b))))
        above = keep and (above or c)
        out += [text] if keep else []
    return "\n".join(reversed(out))


def _pages():
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("abcdé"), rng.integers(2, 8))) + rng.choice(["", "", ",", "."]) for _ in range(n)) + "."
    for i in range(60):
        outer = ["article", "main", "div", "div class='x'", "div id='m7'"][i % 5]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b> y<br>z", "<ul><li>{}</li><li>k</li></ul>", "<blockquote>{}</blockquote>", "<h2>{}</h2>"]).format(words(int(rng.integers(1, 60)))) for _ in range(rng.integers(1, 12)))
        ad = f"<div class='ad'>{words(int(rng.integers(1, 30)))}</div>"
        side = f"<div class='sidebar'><p>{words(int(rng.integers(1, 40)))}</p></div>" if i % 2 else ""
        talk = f"<div class='comments'>{''.join(f'<p>{words(12)}</p>' for _ in range(rng.integers(0, 5)))}</div>"
        yield f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{ad}<{outer}><h1>{words(5)}</h1>{body}{ad if i % 3 else ''}</{outer.split()[0]}>{side}{talk}<div><p>{words(3)}</p></div><footer>f. &copy;</footer></body></html>"


def test_against_a_plain_version(spark, small):
    pages = [*_pages(), *(r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect() if r["html"])]
    for page in pages:
        assert main_text(page) == _plain(page), page
    renamed = [re.sub(r"(</?)article\b", r"\1div", p) for p in pages]
    assert [main_text(p) for p in renamed] == [_plain(p) for p in renamed]


def test_the_threshold_decides(spark, small, monkeypatch):
    pages = [*_pages(), *(r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect() if r["html"])]
    with_it = [main_text(p) for p in pages]
    monkeypatch.setattr(H, "THRESHOLD", 0.0)
    monkeypatch.setattr(H, "SHARE", 0.0)
    without = [main_text(p) for p in pages]
    assert sum(a != b for a, b in zip(with_it, without, strict=True)) > 0.9 * len(pages)


def test_other_paths_give_other_texts(spark, small, monkeypatch):
    """What the ratios choose decides: without article tags the texts are the same, and a random third of the paths that the ratios don't choose changes nearly every page."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect() if r["html"]]
    with_tags, pages = [main_text(p) for p in pages], [re.sub(r"(</?)(article|main)\b", r"\1div", p) for p in pages]
    with_it, rng, real = [main_text(p) for p in pages], np.random.default_rng(2), H._ratios
    assert with_it == with_tags

    def others(page, runs, weight):
        group, plain, chosen = real(page, runs, weight)
        left = np.setdiff1d(group, group[chosen])
        return group, plain, np.isin(group, rng.choice(left, -(-len(left) // 3), replace=False)) if len(left) else chosen

    monkeypatch.setattr(H, "_ratios", others)
    assert sum(a != main_text(p) for a, p in zip(with_it, pages, strict=True)) > 0.9 * len(pages)


def test_lists_of_links_stay_in_an_article():
    body = "".join(f"<p>Paragraph {i}, with a good number of words in it, and some marks, too.</p>" for i in range(4))
    links = "<ul><li><a href=x>First reference</a></li><li><a href=y>Second reference</a></li></ul>"
    menu = "<ul><li><a href=h>Home page</a></li><li><a href=i>Imprint page</a></li></ul>"
    got = main_text(f"<body><div>{menu}</div><article><h1>Title</h1>{body}<h2>References</h2>{links}</article>{menu}</body>")
    assert got.split("\n")[-3:] == ["References", "First reference", "Second reference"] and "page" not in got
    assert "Second reference" in main_text(f"<body>{menu}<div>{body}{links}{body}</div></body>") and "Home" not in main_text(f"<body>{menu}<div>{body}</div></body>")


def test_a_name_weighs_no_more_than_the_text():
    body = "".join(f"<p>Paragraph {i}, with a good number of words in it, and some marks, too.</p>" for i in range(8))
    assert "Buy" not in main_text(f"<body><div class=promo>Buy this, now.</div><div>{body}</div></body>")
    assert "Buy" not in main_text(f"<body><div>Buy this now</div><div>{body}</div></body>")  # no name: the ratio alone
    long = "A promoted story of unusual length, whose sentences, with many marks, go on and on; " * 80
    assert "A promoted story" in main_text(f"<body><div class=promo><p>{long}</p></div><div>{body}</div></body>")


@pytest.mark.parametrize("tag", ["<div>", "<div class='comment x'>", "<x-y>", "<p>", "<li>", "<div id=sidebar><b>a"])
def test_deep_pages_take_linear_time_and_memory(tag):
    def took(n):
        page = "<body><p>Text, here.</p>" + tag * n + "deep" + "</q-q>" * n
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    assert min(took(80_000), took(80_000)) < 3 * 4 * max(took(20_000), took(20_000)) + 0.2  # CPU time, whatever the machine: four times the page, far from 16 times the time
    page = "<body><p>Text, here.</p>" + tag * 100_000 + "deep" + "</q-q>" * 100_000
    if tag == "<div>":
        tracemalloc.start()
        main_text(page)
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
