"""The subpackage's registered queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import bm25_decontam, byte_bpe, chat_tree, embed_neardup, line_dedup, merkle, ngram_jaccard, quality_qda, secret_scan, suffix_dedup, token_pack, turn_repair, va_file
from verbatlas.llm.common import small_batches, tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embed_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.link(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op4_bm25_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_pack.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_tree.with_test_turns(_table(spark, sf_dir, "conversations"))
    return chat_tree.digest(chat_tree.chain(rows))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search(_table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_embed_neardup, op2_secret_scan, op3_line_dedup, op4_bm25_decontam, op5_token_pack, op6_ngram_jaccard, op7_suffix_dedup, op8_quality_qda, op9_chat_tree, op10_byte_bpe, op11_merkle_manifest, op12_exact_topk, op13_turn_repair)}

#: DuckDB has no CRC-32: the table of the reflected polynomial, and the sum over an ASCII text ``s``.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
_CRC = "(4294967295 - list_reduce(list_concat([4294967295], list_transform(range(1, len({s}) + 1), lambda k: ascii({s}[k])::BIGINT)), lambda c, b: xor(c // 256, crc[(xor(c, b) % 256) + 1])))"


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode(CAST({name} AS VARCHAR))) || ':' || {name} END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _inserts(way: str) -> str:
    """The states START, SYSTEM, USER, ASSISTANT of a row's layer (columns w0 to w3) with the inserts that may follow."""
    add = lambda s, role: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 2, 'a': {s}.a || 'I', 't': list_append({s}.t, '{role}:')}} END"
    user = f"list_min([w2, {add('w0', 'user')}, {add('w1', 'user')}, {add('w3', 'user')}])"
    return f"SELECT conv, i, w0, w1, u AS w2, list_min([w3, {add('u', 'assistant')}]) AS w3 FROM (SELECT *, {user} AS u FROM ({way}))"


def _step() -> str:
    """A row's layer from the one before: every edit that leads to each state."""
    put = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': list_append({s}.t, {line})}} END"
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 3, 'a': {s}.a || 'D', 't': {s}.t}} END"
    keep = lambda s, letter: f"CASE WHEN NOT dead AND initial = '{letter}' THEN {put(s, 'cut', 'K', _LINE)} END"
    name = lambda s, role: f"CASE WHEN NOT dead THEN {put(s, '2 + cut', 'R', _LINE.replace('role', chr(39) + role + chr(39)))} END"
    _LINE = "role || ':' || text"
    to_user = ", ".join(f"{keep(s, 'u')}, {name(s, 'user')}" for s in ("w0", "w1", "w3"))
    return f"""SELECT r.conv, r.i, {gone('w0')} AS w0, list_min([{gone('w1')}, {keep('w0', 's')}]) AS w1,
  list_min([{gone('w2')}, {to_user}]) AS w2, list_min([{gone('w3')}, {keep('w2', 'a')}, {name('w2', 'assistant')}]) AS w3
  FROM layers JOIN rows r ON layers.conv IS NOT DISTINCT FROM r.conv AND r.i = layers.i + 1"""


_BEGIN = "SELECT DISTINCT conv_id AS conv, 0::BIGINT AS i, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS w0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS w1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS w2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS w3 FROM conversations"

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, source, sha256({_HEAD} || {_field('text')}) AS leaf,
    sha256({_HEAD} || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || {_LOW} END) AS low,
    coalesce({_CRC.format(s="CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS tampered FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), inner_nodes(source, level, idx, h, n) AS (
  SELECT source, 0, idx, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, level, idx, h, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, min(level) + 1 AS level, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM inner_nodes WHERE n > 1 GROUP BY source, idx // 16)
), subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM inner_nodes WHERE n = 1
), upper_nodes(level, idx, h, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level, idx, h, count(*) OVER () FROM (SELECT min(level) + 1 AS level, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM upper_nodes WHERE n > 1 GROUP BY idx // 16)
), top AS (SELECT h AS root FROM upper_nodes WHERE n = 1),
nodes AS (
  SELECT s.place, level, idx, h FROM inner_nodes n JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source WHERE n.n > 1
  UNION ALL SELECT s.place, height + level, u.idx, u.h
  FROM subroots s JOIN upper_nodes u ON u.n > 1 AND u.idx // 16 = s.place >> (4 * level + 4)
), docs AS (
  SELECT p.*, s.place, subroot, height, root FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source, top
), ways AS (
  SELECT d.doc_id, d.place, d.idx, n.level, string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx < own) AS before, string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx > own) AS after
  FROM (SELECT d.*, l.level, CASE WHEN l.level < height THEN d.idx >> (4 * l.level) ELSE d.place >> (4 * (l.level - height)) END AS own
    FROM docs d, (SELECT unnest(range(15)) AS level) l) d JOIN nodes n ON n.place = d.place AND n.level = d.level AND n.idx // 16 = own // 16 GROUP BY ALL
), proofs AS (
  SELECT place, idx, list({{'b': coalesce(before, ''), 'a': coalesce(after, '')}} ORDER BY level) AS way FROM ways GROUP BY place, idx
), folded AS (
  SELECT d.*, coalesce(way, []) AS way, CASE WHEN tampered THEN low ELSE leaf END AS start FROM docs d LEFT JOIN proofs p ON d.place = p.place AND d.idx = p.idx
), climbed(place, idx, k, h, way) AS (
  SELECT place, idx, 0, start, way FROM folded UNION ALL SELECT place, idx, k + 1, sha256(way[k + 1].b || h || way[k + 1].a), way FROM climbed WHERE k < len(way)
)
SELECT f.doc_id, f.source, f.idx AS position, leaf, subroot, root, sha256(array_to_string(list_transform(f.way, lambda x: x.b || x.a), '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM folded f JOIN climbed c ON f.place = c.place AND f.idx = c.idx AND k = len(f.way)
""",
    "op12_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 20
""",
    "op13_turn_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), hit AS (SELECT conv, turn, role, text, {_CRC.format(s='s')} % 20 AS hit FROM keyed, crc),
damaged AS (
  SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE hit <> 0
), ordered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged),
rows AS (
  SELECT *, role[1] AS initial, blank OR again AS dead, CASE WHEN NOT blank AND NOT again AND ends NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    coalesce(lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS clash
  FROM (SELECT *, core = '' AS blank, core[-1] AS ends, core <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM ordered)
), layers AS (
  {_inserts(_BEGIN)}
  UNION ALL
  {_inserts(_step())}
), ends AS (SELECT conv, list_min([w0, w3]) AS best FROM layers QUALIFY i = max(i) OVER (PARTITION BY conv)),
faults AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE clash) AS illegal
  FROM rows GROUP BY conv
)
SELECT e.conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN faults f ON e.conv IS NOT DISTINCT FROM f.conv
""",
    "op1_embed_neardup": """
WITH RECURSIVE vecs AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), norms AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM vecs WHERE v IS NOT NULL AND len(v) > 0 AND NOT list_contains(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)), true)
), edges AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM norms a JOIN norms b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(vec_id, r) AS (
  SELECT x, x FROM edges UNION SELECT reach.vec_id, edges.y FROM reach JOIN edges ON reach.r = edges.x
), least AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id), counts AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON x = e.vec_id LEFT JOIN least ON least.vec_id = e.vec_id
""",
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS nth FROM windows WHERE line3 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM placed, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT x, x FROM edges UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.r = edges.x
), least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
""",
    "op7_suffix_dedup": """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT doc_id, pos, b[pos:pos + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS pos FROM texts)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS opens FROM windows JOIN firsts USING (s) WHERE doc_id > first
), numbered AS (
  SELECT doc_id, pos, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hits
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 49 AS z FROM numbered GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS nth FROM runs
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed,
    string_agg(CASE WHEN nth = 1 THEN hex(b[1:a - 1]) ELSE '' END || hex(b[z + 1:coalesce(next_a - 1, octet_length(b))]), '' ORDER BY a) AS left_over
  FROM edges JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN left_over IS NULL THEN b ELSE unhex(left_over) END) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
""",
    "op9_chat_tree": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/') AS safe_role,
    replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS safe_text FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || safe_role || '</role>' || safe_text || '</turn>'))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
}
