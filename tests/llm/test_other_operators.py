"""Tool calls, vector search, page extraction and the pipeline."""

import json

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lorewell.llm import html_extract, near_dedup, pii, tool_chat, topk_search
from lorewell.llm.catalog import oracle_sql, queries


# Vectors.

def test_slices_against_products():
    rng = np.random.default_rng(0)
    for n, d, span in ((1, 3, 5), (63, 4, 2), (500, 9, 60), (700, 5, 1)):
        v, ids = rng.integers(-span, span, (n, d)), rng.permutation(n)
        index = topk_search.BitSlices.build(ids, v)
        for q in range(min(n, 20)):
            want = sorted((-int(s), int(i)) for s, i in zip(v @ v[q], ids, strict=True) if i != ids[q])[:5]
            got_ids, scores = index.top(int(ids[q]), v[q], 5)
            assert sorted((-int(s), int(i)) for s, i in zip(scores, got_ids, strict=True)) == want


def test_search_of_a_table(spark, small):
    got = queries()["op6_topk_search"](spark, small).toPandas()
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    m, ids = np.floor(256 * np.stack(e.embedding).astype(float)).astype(np.int64), e.vec_id.to_numpy()
    for q, rows in got.sort_values("rank").groupby("query_id"):
        s = m @ m[np.flatnonzero(ids == q)[0]]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert rows.vec_id.tolist() == ids[best].tolist() and rows.score.tolist() == s[best].tolist() and rows["rank"].tolist() == [1, 2, 3, 4, 5]
    assert got.query_id.nunique() == (ids % 50 == 0).sum()


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (50, [1.0, 0.5]), (50, [1.0, 0.5]), (7, [-0.001, 0.0])]
    v = topk_search.quantised(spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<float>, block string"))
    assert {r["vec_id"]: r["v"] for r in v.collect()} == {0: [256, 128], 50: [256, 128], 7: [-1, 0]}
    got = topk_search.top_k(v, v.where("vec_id % 50 = 0"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(0, 1, 50), (0, 2, 50)]
    assert {(r["vec_id"], r["score"]) for r in got if r["query_id"] == 50} == {(0, 81920), (7, -256)}
    assert topk_search.top_k(v.limit(0), v.limit(0), 2).count() == 0


def test_scores_that_integers_cannot_hold(spark):
    df = lambda *rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for x in (3e16, 1e300, -1e300):
        with pytest.raises(Exception, match="too large|exceed 64-bit"):
            v = topk_search.quantised(df((0, [x, 1.0]), (1, [x, 2.0])))
            topk_search.top_k(v, v.where("vec_id = 0"), 1).collect()
    v = topk_search.quantised(df((0, [4e6, -1.0]), (1, [4e6, 2.0]), (2, [-4e6, 0.0])))
    got = topk_search.top_k(v, v.where("vec_id = 0"), 2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1_024_000_000**2 - 256 * 512), (2, -(1_024_000_000**2))]


def test_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    e = rng.integers(-30, 30, (700, 6)) / 16
    monkeypatch.setattr(topk_search, "BLOCK", 50)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    v = topk_search.quantised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>"))
    got = topk_search.top_k(v, v.where("vec_id % 10 = 0"), 4).toPandas().sort_values(["query_id", "rank"])
    s = (e * 256) @ (e * 256).T
    want = [[i for i in np.lexsort((np.arange(700), -s[q])) if i != q][:4] for q in range(0, 700, 10)]
    assert got.vec_id.to_numpy().reshape(-1, 4).tolist() == want


# Tool calls.

TOOLS = {"tools": [
    {"name": "f", "parameters": {"properties": {"x": {"type": "number"}, "u": {"type": "string", "enum": ["a", "b"]}}, "required": ["x"], "additionalProperties": False}},
    {"name": "g", "parameters": {}},
]}
CALLS = {"content": "ok", "tool_calls": [
    {"id": "B", "name": "f", "arguments": {"x": 1, "u": "b"}, "depends_on": ["A"]}, {"id": "A", "name": "f", "arguments": "{\"x\": 2.50}"}, {"id": "C", "name": "f", "arguments": {"u": "z", "w": 1}},
    {"id": "D", "name": "g", "arguments": {"q": "$E.v"}}, {"id": "E", "name": "g", "arguments": {"q": "$D"}}, {"id": "F", "name": "nope", "arguments": {}}, {"id": "H", "name": "g", "arguments": {"p": "$B.out"}},
]}
ROWS = [
    (1, 0, "system", json.dumps(TOOLS)), (1, 1, "user", "hi \"there\"\n"), (1, 2, "assistant", json.dumps(CALLS)), (1, 3, "tool", json.dumps({"tool_call_id": "A", "content": {"z": 1, "a": [1.5, None]}})),
    (1, 4, "tool", json.dumps({"tool_call_id": "X", "content": "?"})), (1, 5, "tool", json.dumps({"tool_call_id": "B", "content": "r"})), (1, 6, "tool", json.dumps({"tool_call_id": "A", "content": "late"})), (1, 7, None, None),
    (2, 0, "user", "{not json"), (2, 0, "user", "{not json"), (None, None, "assistant", json.dumps({"tool_calls": [{"id": None, "name": "f"}, 5]})), (2, 1, "tool", '{"tool_call_id":"A","content":1}'),
    (3, 0, "user", "[1,2]"), (3, 1, "user", '{"tools":5,"tool_calls":{}}'),
]


def _brute(rows):
    """The same, message by message, in plain Python."""
    def parse(t):
        try:
            v = json.loads(t) if t and t.lstrip().startswith("{") else None
        except ValueError:
            return None
        return v if isinstance(v, dict) else None

    read = [(c, t, r, x, parse(x)) for c, t, r, x in rows]
    lines = []
    for conv, turn, role, text, v in read:
        calls = [x for x in (v or {}).get("tool_calls", []) if isinstance(x, dict)] if isinstance((v or {}).get("tool_calls"), list) else []
        own = [x for x in read if x[0] == conv and x[4]]
        tools = {t["name"]: t["parameters"] for x in own if isinstance(x[4].get("tools"), list) for t in x[4]["tools"]}
        out = []
        ids = {x.get("id"): x for x in calls}
        level: dict = {}
        for _ in range(len(calls) + 1):
            for x in calls:
                text_of = json.dumps(x.get("arguments"))
                needs = {i for i in ids if i is not None and (i in x.get("depends_on", []) or f'"${i}' in text_of)}
                if x.get("id") not in level and needs <= set(level):
                    level[x.get("id")] = 1 + max((level[i] for i in needs), default=-1)
        for pos, x in enumerate(calls):
            args = x.get("arguments")
            args = json.loads(args) if isinstance(args, str) else args
            valid = None
            if x.get("name") in tools:
                schema = tools[x["name"]]
                props = schema.get("properties", {})
                kinds = {"number": (int, float), "string": str}
                valid = isinstance(args, dict) and all(r in args for r in schema.get("required", [])) and all(
                    k in props and isinstance(a, kinds[props[k]["type"]]) and a in props[k].get("enum", [a]) if k in props else schema.get("additionalProperties", True) for k, a in args.items()
                )
            done = [o for o in own if o[4].get("tool_call_id") == x.get("id") and x.get("id") is not None and o[1] > turn]
            item = {"arguments": args, "id": x.get("id"), "level": level.get(x.get("id")), "name": x.get("name"), "result": min(done, key=lambda o: o[1])[4]["content"] if done else None, "valid": valid}
            out.append((99 if item["level"] is None else item["level"], pos, {k: a for k, a in item.items() if a is not None}, bool(done)))
        out.sort(key=lambda x: x[:2])
        call_id = (v or {}).get("tool_call_id")
        linked = None if call_id is None else any(isinstance(o[4].get("tool_calls"), list) and o[1] < turn and any(isinstance(x, dict) and x.get("id") == call_id for x in o[4]["tool_calls"]) for o in own)
        line = {"content": v.get("content") if calls or call_id is not None else text, "role": role, "tool_call_id": None if calls else call_id, "tool_calls": [x[2] for x in out] or None, "turn": turn}
        tally = (len(out), sum(x[3] for x in out), sum(x[2].get("valid") is False for x in out), sum("level" not in x[2] for x in out))
        lines.append((conv, turn, role, *tally, linked, json.dumps({k: a for k, a in line.items() if a is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return lines


def test_tool_calls_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, calls string")
    assert sorted(map(str, map(tuple, tool_chat.link_tool_calls(df).collect()))) == sorted(map(str, _brute(ROWS)))
    plain = df.where("conv_id > 1")
    assert sorted(map(str, map(tuple, tool_chat.link_tool_calls(plain).collect()))) == sorted(map(str, _brute([r for r in ROWS if (r[0] or 0) > 1])))
    assert tool_chat.link_tool_calls(df.limit(0)).count() == 0


def test_white_space_before_an_object(spark):
    rows = [(c, i, "x", " \n\r\t" + json.dumps(json.loads(t), indent=2)) for c, i, _, t in ROWS if c == 1 and i in (0, 2, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, tool_chat.link_tool_calls(df).collect()))) == sorted(map(str, _brute(rows)))


def test_swapped_nulls_keep_messages_apart(spark):
    one = json.dumps({"tool_calls": [{"id": "A", "name": "f"}]})
    rows = [(5, None, "r", one), (None, 5, "r", one), (5, None, None, None), (None, 5, "r", None), (None, None, "r", one), (5, 5, None, "r")]
    got = tool_chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["role"]), r["n_calls"]) for r in got) == sorted((str(c), str(t), str(r), int(x == one)) for c, t, r, x in rows)


def test_long_chains_ladders_and_circles(spark):
    chain = [{"id": f"c{i}", "name": "g", "depends_on": [f"c{i - 1}"] if i else []} for i in range(70)]
    ladder = [{"id": f"l{i}", "name": "g", "depends_on": [f"l{j}" for j in (i - 1, i - 2, i - 5) if j >= 0] + (["c33"] if i == 3 else [])} for i in range(9)]
    circle = [{"id": f"o{i}", "name": "g", "depends_on": [f"o{(i + 1) % 6}"]} for i in range(6)] + [{"id": "after", "name": "g", "depends_on": ["o2", "l4"]}, {"id": "then", "name": "g", "depends_on": ["after"]}]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": chain + ladder + circle})), (2, 0, "assistant", json.dumps({"tool_calls": circle[:6]}))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, tool_chat.link_tool_calls(df).collect()))) == sorted(map(str, _brute(rows)))


def test_results_far_apart(spark, monkeypatch):
    monkeypatch.setattr(tool_chat, "TURNS", 4)
    call = lambda: json.dumps({"tool_calls": [{"id": "A", "name": "f"}, {"id": "B", "name": "f"}]})
    gives = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    rows = [(1, t, "a", call()) for t in (0, 3, 4, 7, 9, 15, 30)] + [(1, t, "t", gives("A", t)) for t in (4, 6, 8, 9, 21)] + [(1, 2, "t", gives("B", 1)), (1, 0, "t", gives("B", 0)), (2, 40, "t", gives("A", 3))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, tool_chat.link_tool_calls(df).collect()))) == sorted(map(str, _brute(rows)))


def test_chat_against_sql(spark, small):
    got = queries()["op4_tool_chat"](spark, small).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = c.sql(oracle_sql()["op4_tool_chat"]).df()
    columns = ["conv_id", "turn", "n_calls", "n_linked", "n_invalid", "line"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))
    assert got.n_linked.sum() > 0 and got.n_invalid.sum() > 0 and got.line.str.contains('"level":1').any()


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>Title, not text.</title><style>p {x: y}</style></head><body class="has-sidebar"><div id="cookie-notice"><p>We use cookies, ok? Please accept them, all of them, now.</p></div>
<header><h1>Site</h1><ul class=menu><li><a href=/>Home</a><li><a href=/b>B</a></ul></header><div id=wrap><div class="content"><h2>Title &amp; more</h2>
<p>First para, with <a href=x>a link</a> and   text, yes. It goes on<br>and on, for long enough to count.</p><p>Short.</p><script>var t = "<p>no</p>";</script><!-- <p>no, not this.</p> -->
<blockquote>Quoted words, here.</blockquote><div class="ad">Buy, now! Only, today.</div><p>Second para, long enough to be content, I hope. A &lt; b, &#233;&eacute;.</p><ul><li>item one, ok.<li>item two.</ul></div>
<div class="sidebar"><h3>Related</h3><p>Something else, entirely. Not main text, at all.</p></div></div><section id=comments><div class=comment><p>Great article, thanks, really. I loved it, so much.</p></div></section>
<form><p>Name, please.</p><input></form><footer><p>(c) us, 2020.</p></footer></body></html>"""


def test_pages():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "First para, with a link and text, yes. It goes on and on, for long enough to count.", "Short.", "Quoted words, here.", "Second para, long enough to be content, I hope. A < b, éé.", "item one, ok.", "item two."
    ]
    marked = "<body><nav><a href=/>x</a></nav><article><h1>H</h1><p><b>One, two.<br><p>Be.</p><aside>No.</aside><section class=comments><p>Me, too, and more, and more.</p></section></article><footer>f.</footer>"
    assert html_extract.main_text(marked) == "H\nOne, two.\nBe."
    for odd in ("", " ", "<", "<p", "</p></p>", "<script>", "<!-- open", "<p>" * 3000, "<a href='x>y"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("x < y & z") == "x < y & z"


def test_uneven_containers_lose_nothing():
    long = "".join(f"<p>Long paragraph number {i}, of the body, with many words in it.</p>" for i in range(20))
    lines = [f"Long paragraph number {i}, of the body, with many words in it." for i in range(20)]
    page = f"<body><article><h1>Title</h1><p>The lead, short.</p><div class=body>{long}</div></article></body>"
    assert html_extract.main_text(page).split("\n") == ["Title", "The lead, short.", *lines]
    second = "<p>Second section, it holds a small share, no more.</p><p>And ends, here.</p>"
    tail = ["Second section, it holds a small share, no more.", "And ends, here."]
    for outer in ("main", "article", "div", "div><div"):
        page = f"<body><{outer}><section>{long}</section><section>{second}</section></{outer.split('>')[0]}></body>"
        assert html_extract.main_text(page).split("\n") == lines + tail
    page = f"<body><article>{long}</article><article>{second}</article></body>"
    assert html_extract.main_text(page).split("\n") == lines + tail
    assert html_extract.main_text(f"<body><h1>Title</h1><div>{long}</div></body>").split("\n") == ["Title", *lines]


def test_names_do_not_empty_a_page():
    body = [f"Long paragraph number {i}, of the body, with many words in it." for i in range(12)]
    long = "".join(f"<p>{x}</p>" for x in body)
    aside = "<div class=sidebar><p>Something else, entirely. Not main, at all.</p></div>"
    for wrapper in ("div class='layout with-sidebar'", "div class=no-sidebar", "div class=has-sidebar", "div class='page form-page'", "div class=hasSidebar", "div id=search", "div class='content sidebar-left'", "form", "form role=form", "div role=form"):
        page = f"<body><{wrapper}><div>{long}</div>{aside}</{wrapper.split()[0]}></body>"
        assert html_extract.main_text(page).split("\n") == body, wrapper
        with_teaser = page.replace("<body>", "<body><div><p>A teaser, outside of it, as long as any of the paragraphs.</p></div>")
        assert set(body) <= set(html_extract.main_text(with_teaser).split("\n")), wrapper
    parts = "".join(f"<div class='x-widget'><p>{x}</p></div>" for x in body)
    assert html_extract.main_text(f"<body><div>{parts}</div></body>").split("\n") == body
    mixed = "".join(f"<div class={c}><p>{x}</p></div>" for c, x in zip(["widget", "promo", "related", "toolbar"] * 3, body, strict=True))
    assert html_extract.main_text(f"<body>{mixed}</body>").split("\n") == body


def test_names_spare_parts_of_an_article():
    long = "<p>A paragraph of the article, with many words in it, and more.</p>" * 4
    for tag in ("section id=discussion", "section id=related-work", "div class=social-history", "div class=section id=sharing"):
        page = f"<body><article><h1>T</h1>{long}<{tag}><h2 id=search>Search</h2><p>One of its sections, here.</p></{tag.split()[0]}></article><footer>f.</footer></body>"
        assert html_extract.main_text(page).split("\n")[-2:] == ["Search", "One of its sections, here."], tag
    for tag in ("section class=comments", "section id=comments", "div class=ad", "form"):
        page = f"<body><article><h1>T</h1>{long}<{tag}><p>No part of it, not at all.</p></{tag.split()[0]}></article><footer>f.</footer></body>"
        assert "No part" not in html_extract.main_text(page), tag
    talk = "<div class=comment><p>Great article, thanks, really. I loved it, so much, and more than that.</p></div>" * 10
    assert "Great" not in html_extract.main_text(f"<body><div class=has-sidebar><div><h1>T</h1>{long}</div><div id=comments>{talk}</div></div></body>")


def test_extraction_of_a_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<p>" + "word, " * 60_000, "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[:2] == [(0, 0), (1, len(html_extract.main_text(PAGE)))] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 6 * 60_000 - 1 and html_extract.extract(df.limit(0)).count() == 0


# The pipeline.

def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, small))
        seen.append(name)
        if name == "near_dedup":
            assert near_dedup.near_duplicates(out).where("not kept").count() == 0
        if name == "pii":
            assert pii.digest(pii.personal_data(out)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert out.where("n_chars <> char_length(text)").count() == 0
        if name == "packing":
            assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == columns and 0 < out.count()
            docs = out
    assert seen == ["toxicity", "near_dedup", "pii", "mixing", "packing"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies string, name string, part int, row string, how string"


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, an empty and a long text, rows that repeat, ids that repeat, clashing names: what each stage keeps is what its own rules say."""
    prose = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [
        (1, prose(1, 40), "en", "a", 10), (1, prose(1, 40), "en", "a", 10), (2, prose(1, 40) + " end", "en", "b", 10), (3, prose(3, 30), None, None, None), (3, prose(4, 30), "de", "a", 1),
        (4, None, "en", "a", 0), (5, "", "en", "b", 0), (None, prose(6, 20), "en", "a", 1), (None, None, None, None, None), (7, prose(7, 60_000), "en", "b", 9), (8, "mail me@x.org, now", "en", "a", 18),
    ]
    docs = spark.createDataFrame([(*r, "c", "n", 1, "r", "h") for r in rows], ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = dict(zip([n for n, _ in corpus_pipeline.STAGES], [None] * 5, strict=True))
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
    key = lambda df: sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in df.collect())
    assert out["toxicity"].count() == len(rows)  # nothing is known to be toxic
    assert key(out["near_dedup"]) == sorted([(1, "w1x0 w1x1"), (3, "w3x0 w3x1"), (3, "w4x0 w4x1"), (4, ""), (5, ""), (0, "w6x0 w6x1"), (0, ""), (7, "w7x0 w7x1"), (8, "mail me@x")])
    assert out["pii"].where("doc_id = 8").first()["text"] == "mail EMAIL, now" or "me@x.org" not in out["pii"].where("doc_id = 8").first()["text"]
    assert out["pii"].columns == out["mixing"].columns == ODD.replace(",", "").split()[::2]
    assert {r["doc_id"] for r in out["mixing"].collect()} <= {r["doc_id"] for r in out["pii"].collect()} and out["mixing"].groupBy("doc_id", "text").count().where("count > 2").count() == 0
    assert out["packing"].select("doc_id").distinct().count() == out["mixing"].select("doc_id").distinct().count()
    empty = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.materialize(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_media", "op5_packing", "op7_pii", "op8_near_dedup", "op9_toxicity", "op10_html_extract"])
def test_queries_return_every_row(spark, small, name):
    got = queries()[name](spark, small)
    source = "pages" if name.startswith("op10") else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    assert got.select(key).distinct().count() == spark.read.parquet(f"{small}/{source}.parquet").count()
