import random
import re
from hashlib import sha256

import pytest

from lorewell.llm.decontaminate import contamination


def plain(docs, items, window=10):
    """Every window at every place, by definition."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, have = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if own := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    have |= own
        out.append((doc, len(w), len(hit), sorted(str(x) for x in have if x is not None), bool(hit)))
    return out


def rows(frame):
    return [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in frame.collect()]


def order(found):
    return sorted(found, key=str)


@pytest.mark.parametrize(("window", "shingle"), [(10, 5), (4, 2)])
def test_equal_to_every_window_at_every_place(spark, window, shingle):
    rng = random.Random(window)
    vocabulary = ["a", "b", "Über", "x1", "été", "Long" * 30, "la"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 25))) for i in range(40)] + [(100, "a b a b a b a b a b a b"), (100, "la"), (None, "b b"), (101, None), (9, "A, b"), (10, "a b")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(None, "a b"), (7, None), (7, ""), (8, "?!"), (8, "ab ab")]
    docs += [(200 + i, text(5) + " " + items[rng.randrange(40)][1] + " " + text(9)) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rid", "'x' AS n_words", "2 AS key").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS words").repartition(2)
    found = contamination(d, b, window, shingle)
    assert order(rows(found)) == order(plain(docs, items, window))
    for r in found.collect():
        assert r.n_items == len(r.item_ids) and sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_long_stretches_and_copies(spark):
    """One passage in most documents, one document of a passage many times over, an item that is a common word."""
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(30)}" for _ in range(40))
    items = [(1, passage), (2, passage + " more"), (3, "the"), (4, " ".join(f"w{rng.randrange(30)}" for _ in range(30)))]
    docs = [(i, ("the " * 3 + passage + f" own{i} ") if i % 3 else f"the own{i}") for i in range(300)] + [(1000, (passage + " ") * 400), (1001, "the " * 9000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert order(rows(contamination(d, b))) == order(plain(docs, items))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(contamination(docs, items.limit(0))) == [(1, 2, 0, [], False)]
    assert rows(contamination(docs.limit(0), items)) == []
    assert rows(contamination(docs, items)) == [(1, 2, 2, ["1"], True)]
    assert sha256(b"").hexdigest().startswith("e3b0")
