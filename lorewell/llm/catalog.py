"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.decontaminate import contamination
from lorewell.llm.html_extract import extract
from lorewell.llm.media import image_features, with_images
from lorewell.llm.mixing import mix
from lorewell.llm.near_dedup import near_duplicates
from lorewell.llm.packing import pack
from lorewell.llm.periodic_runs import digest as runs_digest
from lorewell.llm.periodic_runs import periodic_runs, with_periods
from lorewell.llm.pii import digest, personal_data
from lorewell.llm.prefix_trie import placed_turns, prefix_trie, rebuilt
from lorewell.llm.shared import materialize, table
from lorewell.llm.suffix_dedup import remove_repeats
from lorewell.llm.tool_chat import link_tool_calls, with_calls
from lorewell.llm.topk_search import quantised, top_k
from lorewell.llm.toxicity import fit, held_out, toxic_passages


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Windows of 200 bytes are told by a 64-bit hash, bytes written as pairs of hexadecimal digits.
OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, hash(x[i + 1:i + 200]) AS h FROM (SELECT doc_id, x, unnest(range(0, octet_length(x)::BIGINT - 199)) AS i FROM d)),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, octet_length(x)::BIGINT, octet_length(x)::BIGINT FROM d),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS last FROM ends)
SELECT doc_id, any_value(octet_length(x))::BIGINT AS n_bytes, sum(b - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
  sha256(unhex(string_agg(CASE WHEN a > last THEN hex(x[last + 1:a]) ELSE '' END, '' ORDER BY a, b))) AS kept_sha256
FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_features(with_images(table(spark, sf_dir, "documents"))).drop("error")


def op4_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages make no calls of their own: users' messages are calls of a tool and assistants' their results, see with_calls()."""
    return link_tool_calls(with_calls(table(spark, sf_dir, "conversations")))


#: Calls of one conversation two turns apart are a chain: their levels are places in runs of such turns.
OP4_SQL = """
WITH m AS (SELECT conv_id, turn, role, text, to_json(text)::VARCHAR AS body, to_json(role)::VARCHAR AS who FROM conversations),
called AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'user'),
chain AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level
  FROM (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM called)),
given AS (SELECT conv_id, turn, min(body) AS body FROM m WHERE role = 'assistant' GROUP BY conv_id, turn),
called_valid AS (SELECT m.*, level, g.conv_id IS NOT NULL AS has, g.body AS result, coalesce(length(text) BETWEEN 1 AND 299, false) AS valid,
  CASE WHEN text IS NULL THEN '{}' ELSE '{"chars":' || length(text) || ',"tone":"' || CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 300 THEN 'long' ELSE 'endless' END || '"}' END AS arguments
  FROM m JOIN chain c ON m.conv_id = c.conv_id AND m.turn = c.turn LEFT JOIN given g ON g.conv_id = m.conv_id AND g.turn = m.turn + 1 WHERE role = 'user')
SELECT conv_id, turn, role, 1::BIGINT AS n_calls, has::BIGINT AS n_linked, (NOT valid)::BIGINT AS n_invalid, 0::BIGINT AS n_cyclic, NULL::BOOLEAN AS linked,
  '{' || coalesce('"content":' || body || ',', '') || '"role":' || who || ',"tool_calls":[{"arguments":' || arguments || ',"id":"call-' || turn || '","level":' || level || ',"name":"reply",'
  || coalesce('"result":' || result || ',', '') || '"valid":' || valid || '}],"turn":' || turn || '}' AS line FROM called_valid
UNION ALL
SELECT m.conv_id, m.turn, role, 0, 0, 0, 0, c.conv_id IS NOT NULL,
  '{' || coalesce('"content":' || body || ',', '') || '"role":' || who || ',"tool_call_id":"call-' || (m.turn - 1) || '","turn":' || m.turn || '}' FROM m LEFT JOIN called c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1 WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, role, 0, 0, 0, 0, NULL, '{' || coalesce('"content":' || body || ',', '') || coalesce('"role":' || who || ',', '') || '"turn":' || turn || '}' FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


def tokenizer_path() -> str:
    """Where the public tokenizer files are installed; they are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


#: Scores below 2**53, as these are, are exact as doubles.
OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle, and what is reachable over the pairs that are similar enough.
OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic_passages(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP11_SQL = """
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS t, least(10, len(w)) AS n FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM x) ON len(w) >= n)),
o AS MATERIALIZED (SELECT doc_id, k, p.n, item_id FROM p JOIN x ON p.t = x.t AND p.n = x.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts are made periodic first, see with_periods()."""
    return runs_digest(periodic_runs(with_periods(table(spark, sf_dir, "documents"))))


#: Equal words of a document are paired for every period; neighbouring pairs are a stretch. The checksum of the id is worked out bit by bit.
OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, doc_id::VARCHAR AS s FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(range(0, 8 * length(s)), lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1,
  3988292384 * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1)), 4294967295::BIGINT)) AS h FROM d),
g AS (SELECT *, h // 10 AS g, h // 10 % greatest(n, 1) AS a FROM c),
p AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
t AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM p),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM e) GROUP BY doc_id, p, k),
r AS MATERIALIZED (SELECT doc_id, s, len, min(p) AS p FROM s WHERE len >= greatest(6, 4 * p) GROUP BY doc_id, s, len),
f AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := s, l := len, p := p) ORDER BY len / p DESC, s, p) AS best, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM r GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text FROM t LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM r) x ON x.doc_id = t.doc_id AND x.i = t.i WHERE x.i IS NULL GROUP BY t.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256 FROM p LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations share beginnings with others of their family first, see rebuilt()."""
    return prefix_trie(*rebuilt(materialize(placed_turns(table(spark, sf_dir, "conversations")))))


#: A node is told by the text of its turns; every node is summed over all prefixes of one of its members.
OP13_SQL = """
WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(v ORDER BY i) AS v FROM t GROUP BY conv_id),
k AS (SELECT conv_id, v, xor(4294967295, list_reduce(range(0, 8 * length(s)), lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1,
  3988292384 * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1)), 4294967295::BIGINT)) % 9 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM l)),
b AS (SELECT k.conv_id, list_concat(coalesce(l.v[1:h], []), k.v[h + 1:]) AS v FROM k LEFT JOIN l ON l.conv_id = k.conv_id - k.conv_id % 5),
m AS MATERIALIZED (SELECT conv_id, d, sha256(v[1:d]::VARCHAR) AS key, CASE WHEN d > 0 THEN sha256(v[1:d - 1]::VARCHAR) END AS up, coalesce(strlen(v[d].text), 0) AS size, d = len(v) AS ends
  FROM (SELECT conv_id, v, unnest(range(0, len(v) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
c AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
f AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key, d) LEFT JOIN n p ON p.key = n.up AND p.d = n.d - 1),
a AS (SELECT a.key, a.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(CASE WHEN f.d > 0 THEN (f.n_convs - 1) * f.size ELSE 0 END) AS saved
  FROM f JOIN m o ON o.key = f.key AND o.d = f.d AND o.conv_id = f.conv_id JOIN m a ON a.conv_id = o.conv_id AND a.d <= o.d GROUP BY a.key, a.d)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM f JOIN a USING (key, d)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_media, op4_tool_chat, op5_packing, op6_topk_search, op7_pii, op8_near_dedup, op9_toxicity, op10_html_extract, op11_decontamination, op12_periodic_runs, op13_prefix_trie)}


def oracle_sql() -> dict:
    return {"op1_suffix_dedup": OP1_SQL, "op4_tool_chat": OP4_SQL, "op6_topk_search": OP6_SQL, "op8_near_dedup": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
