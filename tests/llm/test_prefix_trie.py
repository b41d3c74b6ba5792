import random
import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from lorewell.llm import prefix_trie as module
from lorewell.llm.prefix_trie import peeled, placed_turns, prefix_trie, rebuilt


def plain(rows):
    """Row by row, by definition. rows: conv_id, turn, role, text."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], sha256(ends(k).encode()).hexdigest()) for k, m in members.items()),
        key=lambda r: (r[1], r[0]),
    )


def trie(frame):
    turns, convs = rebuilt(placed_turns(frame))
    return sorted(map(tuple, prefix_trie(turns, convs).collect()), key=lambda r: (r[1], r[0]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_odd_rows_equal_to_the_definition(spark, monkeypatch):
    """Nulls in all columns, ties, repeated rows, turnless conversations, copies in two and in many conversations, ids below 0, parts and chunks that are smaller than conversations."""
    monkeypatch.setattr(module, "PART", 3)
    monkeypatch.setattr(module, "CHUNK", 20)
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 1 << 40]:
        for turn in range(rng.randrange(1, 16)):
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "b c"])))
    for c in range(100, 240):  # a third: one conversation many times over
        rows += [(c, turn, "user", f"copy {turn}") for turn in range(9 if c % 3 else 12)]
    rows += [(7, 1, "user", "a")] * 3 + [(None, 0, "user", "nobody")] + [(300, None, None, None)]
    wide = frame(spark, rows).selectExpr("*", "1 AS place", "'z' AS x", "0 AS depth").repartition(4)
    assert trie(wide) == plain(rows)


def test_long_chains_and_combs_take_few_rounds(spark, monkeypatch):
    """200 turns that two conversations share, and 60 conversations that leave a shared one turn by turn."""
    rows = [(c, turn, "user", f"long {turn}") for c in (1000, 2000) for turn in range(200)]
    rows += [(5 * c, turn, "user", f"comb {turn}" if turn < c + 10 else f"own {c}") for c in range(60, 120) for turn in range(c + 11)]
    states = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: states.append(df.columns) or real(df))
    assert trie(frame(spark, rows)) == plain(rows)
    assert sum("complete" in c for c in states) <= 14  # depths go to 200


def test_peeling_alone(spark):
    """A node that waits for one that waits, one of several children, the root."""
    nodes = spark.createDataFrame(
        [(1, 0, None, 1, 1, 0, 0), (1, 1, 1, 2, 1 ^ 3, 0, 5), (1, 2, 1, 1, 1, 0, 7), (3, 2, 1, 0, 0, 1, 0), (1, 3, 1, 0, 0, 1, 11)],
        "conv_id long, depth long, up long, left long, child long, n_leaves long, saved long",
    )
    got = sorted(map(tuple, peeled(nodes).collect()), key=lambda r: (r[1], r[0]))
    assert got == [(1, 0, 2, 23), (1, 1, 2, 23), (1, 2, 1, 18), (3, 2, 1, 0), (1, 3, 1, 11)]


def test_no_rows(spark):
    empty = frame(spark, [(1, 0, "user", "a")]).limit(0)
    assert trie(empty) == [] and trie(frame(spark, [(None, 0, "user", "a")])) == []
    # Conversation 1 starts with turns of conversation 0, which isn't there, and loses its own: it has no turns.
    assert zlib.crc32(b"1") % 9 > 0
    assert trie(frame(spark, [(1, 0, "user", "a")])) == plain([(1, 0, "user", "a")]) == [(1, 0, None, 1, 0, 1, 0, sha256(b"1").hexdigest())]
    assert placed_turns(empty).select(F.count("*")).first()[0] == 0
