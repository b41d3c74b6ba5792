import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from lorewell.llm.periodic_runs import digest, periodic_runs, runs_of, with_periods


def plain_runs(w, times=4, least=6):
    """By definition: every period, every stretch, and no divisor of the period is one too."""
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            e = i
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            s, n = i, e + p - i
            if e > i and n >= max(least, times * p) and not any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, p)):
                out.append((s, n, p))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    """A row of the registered query."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def random_words(rng):
    kind, n = rng.randrange(4), rng.randrange(0, 90)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abcdefghij") for _ in range(n)]
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += (unit * 12)[: rng.randrange(1, 7 * len(unit) + 1)]
    return out


@pytest.mark.parametrize(("times", "least"), [(4, 6), (3, 2), (3, 10), (5, 1)])
def test_runs_are_those_by_definition(times, least):
    rng = random.Random(times)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 12))]
        flat = [x for t in texts for x in t]
        codes = np.unique(np.array(flat, dtype="U1"), return_inverse=True)[1] if flat else np.zeros(0, dtype=np.int64)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        want = [(first[i] + s, first[i] + s + n, p) for i, t in enumerate(texts) for s, n, p in plain_runs(t, times, least)]
        assert sorted(runs_of(codes, first, times, least)) == sorted(want)


def test_one_word_many_times_is_linear_in_memory_and_one_run():
    codes = np.zeros(300_000, dtype=np.int64)
    assert runs_of(codes, np.array([0, 300_000])) == [(0, 300_000, 1)]


def test_query_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(random_words(rng)) + rng.choice(["", " ", "\n", "\t x"])) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "é " * 7), (403, "é " * 7), (None, "a b " * 9), (404, "x\x0by\x0bx\x0by\x0bx\x0by\x0bx\x0by"), (-7, "k " * 5), (405, "word word " * 6)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    got = digest(periodic_runs(with_periods(docs))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert sum(r.n_runs for r in got) > 300
    assert periodic_runs(docs.limit(0)).count() == 0
    whole = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert whole[403].collapsed == "é" and whole[403].n_words == 7 and [tuple(r) for r in whole[403].runs] == [(0, 7, 1)]
