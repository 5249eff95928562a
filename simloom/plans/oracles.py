"""DuckDB SQL for the queries of ``simloom.plans.queries``."""

from __future__ import annotations

from simloom.config import EXTENSIONS
from simloom.functions.tokens import IGNORED
from simloom.operators.synonyms import SMALL_DICTIONARY
from simloom.plans.queries import CODE, NAMES

_IGNORED = ", ".join("'" + w + "'" for w in IGNORED)


def _blocks(name: str, source: str, block: str, file: str, least: int = 3) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT {block}::BIGINT AS id, ({file})::VARCHAR AS file, list_filter(
    regexp_extract_all(coalesce(text, ''), '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*'),
    lambda t: strlen(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_IGNORED})) AS toks FROM {source})
  WHERE len(toks) >= {least})"""


_DOCS = _blocks("blocks", "documents", "doc_id", "doc_id")


def _tf(blocks: str = "blocks", tf: str = "tf") -> str:
    return f"""occ_{tf} AS (SELECT id, len(toks) AS total, unnest(toks) AS token FROM {blocks}),
{tf} AS (SELECT id, token, count(*) AS cnt, count(*)::DOUBLE / any_value(total) AS f FROM occ_{tf} GROUP BY id, token)"""


def _simhash(blocks: str = "blocks", tf: str = "tf", name: str = "hashed") -> str:
    bit = lambda i: f"CASE WHEN sum(cnt * (2 * ((h >> {i}) & 1)::BIGINT - 1)) > 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END"
    return f"""{name} AS (
  SELECT b.id, b.file, len(b.toks) AS n, b.toks, s.h FROM {blocks} b JOIN (
    SELECT id, {" | ".join(f"({bit(i)})" for i in range(64))} AS h
    FROM (SELECT id, cnt, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS h FROM {tf}) GROUP BY id) s USING (id))"""


_NEAR = "bit_count(xor(a.h, b.h)) <= {d} AND a.n <= 2 * b.n AND b.n <= 2 * a.n"
_OVERLAP = """CASE WHEN a.n < b.n THEN list_has_any(a.toks[1:20], b.toks) WHEN b.n < a.n THEN list_has_any(b.toks[1:20], a.toks)
  ELSE list_has_any(a.toks[1:20], b.toks) OR list_has_any(b.toks[1:20], a.toks) END"""


def _pairs(distance: int = 10, overlap: bool = True) -> str:
    return f"""pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, a.file AS file_a, b.file AS file_b, bit_count(xor(a.h, b.h))::INT AS hd
  FROM hashed a JOIN hashed b ON a.id < b.id AND a.file <> b.file AND {_NEAR.format(d=distance)} {"AND " + _OVERLAP if overlap else ""})"""


def _scored(penalty: float = 2.0, tf_a: str = "tf", tf_b: str = "tf") -> str:
    w2 = f"power(1.0 / (1.0 + {penalty} * sqrt(x.f * y.f)), 2)"
    return f"""sums AS (
  SELECT id_a, id_b, sum(x.f * y.f * {w2}) AS dot, sum(x.f * x.f * (1 - {w2})) AS ra, sum(y.f * y.f * (1 - {w2})) AS rb
  FROM pairs JOIN {tf_a} x ON x.id = id_a JOIN {tf_b} y ON y.id = id_b AND y.token = x.token GROUP BY id_a, id_b),
norm_a AS (SELECT id AS id_a, sum(f * f) AS na FROM {tf_a} GROUP BY id),
norm_b AS (SELECT id AS id_b, sum(f * f) AS nb FROM {tf_b} GROUP BY id),
scored AS (
  SELECT p.*, coalesce(dot / sqrt((na - ra) * (nb - rb)), 0.0) AS similarity
  FROM pairs p LEFT JOIN sums USING (id_a, id_b) JOIN norm_a USING (id_a) JOIN norm_b USING (id_b))"""


def _cascade(blocks: str, penalty: float = 2.0, overlap: bool = True, distance: int = 10) -> str:
    return ",\n".join(("WITH " + blocks, _tf(), _simhash(), _pairs(distance, overlap), _scored(penalty)))


_NEAR_DUP = _cascade(_DOCS)
_BEST = f"""{_cascade(_blocks("blocks", "documents", "doc_id", "source"))},
lines AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
turned AS (
  SELECT least(file_a, file_b) AS fa, greatest(file_a, file_b) AS fb, CASE WHEN file_a < file_b THEN id_a ELSE id_b END AS ia,
    CASE WHEN file_a < file_b THEN id_b ELSE id_a END AS ib, similarity FROM scored WHERE similarity >= 0.85),
best AS (
  SELECT fa, fb, round(similarity, 6) AS similarity, la.n AS na, lb.n AS nb FROM (
    SELECT * FROM turned QUALIFY row_number() OVER (PARTITION BY fa, fb ORDER BY round(similarity, 9) DESC, ia, ib) = 1)
  JOIN lines la ON la.doc_id = ia JOIN lines lb ON lb.doc_id = ib)"""
_PLACE = "{{'physicalLocation': {{'artifactLocation': {{'uri': {f}}}, 'region': {{'startLine': 1}}}}}}"
_BUCKET = "CASE WHEN {n} <= 10 THEN 0 WHEN {n} <= 25 THEN 1 WHEN {n} <= 50 THEN 2 WHEN {n} <= 100 THEN 3 WHEN {n} <= 200 THEN 4 WHEN {n} <= 500 THEN 5 ELSE 6 END"
_COUNTS = f"""{_DOCS}, counts AS (SELECT id, len(toks)::INT AS t, len(list_distinct(toks))::INT AS d, toks FROM blocks),
signed AS (SELECT id, t, d, toks, {_BUCKET.format(n="t")}::INT AS cb, least(7, floor(d * 10.0 / t))::INT AS db FROM counts),
packed AS (SELECT *, cb::BIGINT | (db::BIGINT << 5) | (('0x' || substr(md5(toks[1]), 15, 2))::BIGINT << 8) | (('0x' || substr(md5(toks[-1]), 15, 2))::BIGINT << 16) | ((t & 65535)::BIGINT << 24) | ((d & 65535)::BIGINT << 40) AS signature FROM signed)"""
_HEX = "SELECT id AS doc_id, lower(lpad(to_hex(h), 16, '0')) AS simhash_hex FROM hashed"
_NAMES = ", ".join(f"('{n}')" for n in NAMES)
_CAP = "upper({x}[1:1]) || lower({x}[2:])"
_IDENTIFIERS = f"""idents AS (
  SELECT DISTINCT identifier FROM (
    SELECT 'get' || {_CAP.format(x="w[1]")} || {_CAP.format(x="w[-1]")} AS identifier FROM (SELECT string_split(p_name, ' ') AS w FROM part)
    UNION ALL SELECT replace(lower(p_name), ' ', '_') FROM part
    UNION ALL SELECT 'fetch' || {_CAP.format(x="w[1]")} || p_size FROM (SELECT string_split(p_name, ' ') AS w, p_size FROM part)))"""
_WORDS = "list_filter(string_split(lower(regexp_replace({x}, '(\\p{{Lu}})', '_\\1', 'g')), '_'), lambda w: w <> '')"
_SIGNATURE = """(CASE WHEN lower({x}[1:1]) BETWEEN 'a' AND 'z' THEN ascii(lower({x}[1:1])) - 97 ELSE 0 END
  + 64 * CASE WHEN strlen({x}) <= 3 THEN 0 WHEN strlen({x}) <= 6 THEN 1 WHEN strlen({x}) <= 10 THEN 2 WHEN strlen({x}) <= 15 THEN 3 ELSE 4 END
  + 512 * least(7, len(regexp_extract_all({x}, '[\\p{{Lu}}_]')))
  + CASE WHEN regexp_matches({x}, '[0-9]') THEN 4096 ELSE 0 END + CASE WHEN contains({x}, '_') THEN 8192 ELSE 0 END
  + CASE WHEN regexp_matches({x}, '^\\p{{Lu}}') THEN 16384 ELSE 0 END + CASE WHEN regexp_matches({x}, '\\p{{Ll}}\\p{{Lu}}') THEN 32768 ELSE 0 END)::INT"""
_LINES = ", ".join(f"({i}, '{line}')" for i, line in enumerate(SMALL_DICTIONARY.splitlines()))
_EDGES = f"""raw AS (
  SELECT i, lower(trim(string_split(line, '|')[1])) AS w, string_split(string_split(line, '|')[2], ',') AS syns FROM (VALUES {_LINES}) t(i, line)),
one AS (SELECT i, k - 1 AS pos, w, lower(trim(syns[k])) AS s FROM (SELECT *, unnest(range(1, len(syns) + 1)) AS k FROM raw)),
sides AS (SELECT i, pos, 0 AS back, w AS word, s AS synonym FROM one UNION ALL SELECT i, pos, 1, s, w FROM one),
edges AS (SELECT word, (row_number() OVER (PARTITION BY word ORDER BY i, pos, back, synonym) - 1)::INT AS ord, synonym, 1.0::FLOAT AS weight FROM sides)"""
_ALL_NAMES = f"{_IDENTIFIERS}, names AS (SELECT * FROM idents UNION SELECT * FROM (VALUES {_NAMES}) t(identifier))"
_EXPANDED = f"""{_EDGES},
words AS (SELECT identifier, p - 1 AS word_pos, ws[p] AS word FROM (SELECT identifier, ws, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT identifier, {_WORDS.format(x="identifier")} AS ws FROM names))),
hop1 AS (SELECT identifier, word_pos, w.word AS source, e.ord AS o, e.synonym AS word FROM words w JOIN edges e ON e.word = w.word),
leads AS (SELECT identifier, word_pos, source, arg_min(word, o) AS lead_word FROM hop1 GROUP BY ALL),
hop2 AS (
  SELECT l.identifier, l.word_pos, e.ord AS o, e.synonym AS word FROM leads l JOIN edges e ON e.word = l.lead_word
  WHERE e.synonym <> l.source AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.identifier = l.identifier AND h.word_pos = l.word_pos AND h.word = e.synonym)),
writes AS (
  SELECT identifier, word_pos, 0 AS hop, 0 AS o, word, 1.0 AS score FROM words
  UNION ALL SELECT identifier, word_pos, 1, o, word, 0.9 FROM hop1 UNION ALL SELECT identifier, word_pos, 2, o, word, 0.81 FROM hop2),
expanded AS (SELECT identifier, word, arg_max(score, word_pos * 1000000 + hop * 1000 - o)::DOUBLE AS score FROM writes GROUP BY ALL)"""
_EXPAND = f"{_ALL_NAMES}, {_EXPANDED}"
_ALIKE = f"""norms AS (SELECT identifier, sum(score * score) AS n2 FROM expanded GROUP BY 1),
near AS (SELECT identifier, list(DISTINCT e.synonym) AS near FROM words w JOIN edges e ON e.word = w.word GROUP BY 1),
sigs AS (SELECT identifier, {_SIGNATURE.format(x='identifier')} AS s, {_WORDS.format(x='identifier')} AS ws FROM names),
dots AS (SELECT a.identifier AS id1, b.identifier AS id2, sum(a.score * b.score) AS dot FROM expanded a JOIN expanded b USING (word) WHERE a.identifier <> b.identifier GROUP BY 1, 2),
compared AS (
  SELECT id1, id2,
    lower(id1) = lower(id2) OR (bit_count(xor(a.s, b.s)) <= 8 AND abs(len(a.ws) - len(b.ws)) <= 2
      AND (list_has_any(a.ws, b.ws) OR coalesce(list_has_any(near.near, b.ws), false))) AS fast,
    CASE WHEN bit_count(xor(a.s, b.s)) <= 12 THEN dot / sqrt(x.n2 * y.n2) ELSE 0 END AS similarity
  FROM dots JOIN sigs a ON a.identifier = id1 JOIN sigs b ON b.identifier = id2
  LEFT JOIN near ON near.identifier = id1 JOIN norms x ON x.identifier = id1 JOIN norms y ON y.identifier = id2)"""
_EXTENSIONS = ", ".join(f"'{e}'" for e in (*EXTENSIONS, "html"))
_PATH = "regexp_replace(url, '[?#].*$', '')"
_SOURCE = _blocks("blocks", "documents", "doc_id", "source")
_TURNS = _blocks("blocks", "conversations", "conv_id * 1000 + turn", "conv_id")
_PAIR_OUT = "SELECT id_a, id_b, round(similarity, 6) AS similarity FROM scored"
_SIZES = "sizes AS (SELECT len(toks) AS t, count(*) AS n FROM blocks GROUP BY 1)"
_SIZE_PAIRS = """sized AS (
  SELECT a.t, CASE WHEN a.t = b.t THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS c
  FROM sizes a JOIN sizes b ON a.t <= b.t AND b.t <= 2 * a.t)"""

#: What the extraction rules give for the sources of ``queries.CODE``, by reading them: functions, their
#: bodies over five rows or more; names alone, without types, one-byte names and ignored words.
_BLOCKS_OF_CODE = """
  ('a/sum.c', 0, 'function', 1, 7, 'addAll values count total index index count index total values index total'),
  ('a/sum.c', 1, 'block', 1, 7, 'total index index count index total values index total'),
  ('b/sum.c', 0, 'function', 1, 7, 'sumAll values count total index index count index total values index total'),
  ('b/sum.c', 1, 'block', 1, 7, 'total index index count index total values index total'),
  ('a/sum.rs', 0, 'function', 1, 7, 'add_all values total value values total value total'),
  ('a/sum.rs', 1, 'block', 1, 7, 'total value values total value total'),
  ('a/Sum.java', 0, 'function', 2, 8, 'addAll values total value values total value total'),
  ('a/Sum.java', 1, 'block', 2, 8, 'total value values total value total')"""
_SOURCES = ", ".join("('{}', '{}')".format(f, t.replace("\n", "' || chr(10) || '")) for f, t in CODE)
_REGION = "array_to_string(string_split({t}.text, chr(10))[{a}:{b}], chr(10))"

ORACLES: dict[str, str] = {
    "q_extract_blocks": f"SELECT * FROM (VALUES {_BLOCKS_OF_CODE}) t(file, ordinal, kind, start_line, end_line, tokens)",
    "q_report_lines": f"""WITH src AS (SELECT * FROM (VALUES {_SOURCES}) t(file, text)),
pairs AS (SELECT * FROM (VALUES ('a/Sum.java', 2, 8, 'a/sum.rs', 1, 7), ('a/sum.c', 1, 7, 'b/sum.c', 1, 7)) t(file_a, a1, a2, file_b, b1, b2))
SELECT file_a, file_b, {_REGION.format(t="x", a="a1", b="a2")} AS lines_a, {_REGION.format(t="y", a="b1", b="b2")} AS lines_b
FROM pairs JOIN src x ON x.file = file_a JOIN src y ON y.file = file_b""",
    "q_tokens": f"WITH {_COUNTS} SELECT id AS doc_id, t AS total_tokens, d AS distinct_tokens, toks[1] AS first_token, toks[-1] AS last_token FROM counts",
    "q_term_freq": f"WITH {_DOCS}, {_tf()} SELECT id AS doc_id, token, cnt, round(f, 9) AS tf FROM tf",
    "q_min_token_filter": f"WITH {_blocks('blocks', 'documents', 'doc_id', 'doc_id', 100)} SELECT id AS doc_id, len(toks)::INT AS total_tokens FROM blocks",
    "q_simhash": f"WITH {_DOCS}, {_tf()}, {_simhash()} {_HEX}",
    "q_simhash_columns": f"WITH {_DOCS}, {_tf()}, {_simhash()} {_HEX}",
    "q_block_signature": f"WITH {_COUNTS} SELECT id AS doc_id, cb AS count_bucket, db AS distinct_bucket, signature FROM packed",
    "q_signature_compat": f"""WITH {_COUNTS}, g AS (SELECT signature AS s, count(*) AS n FROM packed GROUP BY 1)
SELECT a.s AS signature, any_value(a.n) AS own, sum(b.n)::BIGINT AS compatible FROM g a JOIN g b ON abs((a.s & 65535) - (b.s & 65535)) <= 16 GROUP BY a.s""",
    "q_hamming_pairs": f"WITH {_DOCS}, {_tf()}, {_simhash()}, {_pairs(10, False)} SELECT id_a, id_b, hd, round((64 - hd) / 64.0, 6)::DOUBLE AS est FROM pairs",
    "q_size_ratio_pairs": f"WITH {_DOCS}, {_SIZES}, {_SIZE_PAIRS} SELECT {_BUCKET.format(n='t')}::INT AS bucket, sum(c)::BIGINT AS pairs FROM sized GROUP BY 1",
    "q_shared_token_pairs": f"WITH {_DOCS}, {_tf()}, {_simhash()}, {_pairs()} SELECT id_a, id_b FROM pairs",
    **{f"q_cosine_p{p}": f"{_cascade(_DOCS, p, False)} {_PAIR_OUT} WHERE similarity >= 0.85" for p in (0, 2, 5)},
    "q_cosine_relational": f"{_cascade(_DOCS, 2.0, False)} {_PAIR_OUT}",
    "q_near_dup_pairs": f"{_NEAR_DUP} {_PAIR_OUT} WHERE similarity >= 0.85",
    "q_near_dup_cross_source": f"""{_cascade(_SOURCE)} SELECT least(file_a, file_b) AS file_a, greatest(file_a, file_b) AS file_b, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.85 GROUP BY least(file_a, file_b), greatest(file_a, file_b)""",
    "q_near_dup_turns": f"{_cascade(_TURNS, 2.0, True, 64)} {_PAIR_OUT} WHERE similarity >= 0.5",
    "q_benchmark_contamination": f"""WITH {_blocks("ba", "benchmark", "item_id", "item_id")}, {_blocks("bb", "documents", "doc_id", "doc_id")},
{_tf("ba", "tfa")}, {_tf("bb", "tfb")}, {_simhash("ba", "tfa", "ha")}, {_simhash("bb", "tfb", "hb")},
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM ha a JOIN hb b ON {_NEAR.format(d=64)} AND {_OVERLAP}),
{_scored(2.0, "tfa", "tfb")} SELECT id_a AS item_id, id_b AS doc_id, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.3""",
    "q_severity": f"""{_NEAR_DUP} SELECT CASE WHEN similarity >= 0.95 THEN 'critical' WHEN similarity >= 0.85 THEN 'high' WHEN similarity >= 0.75 THEN 'medium' ELSE 'low' END AS severity,
count(*) AS n FROM scored WHERE similarity >= 0.85 GROUP BY 1""",
    "q_summary": f"{_NEAR_DUP} SELECT count(*) AS pairs, (SELECT count(DISTINCT f) FROM (SELECT file_a AS f FROM scored WHERE similarity >= 0.85 UNION ALL SELECT file_b FROM scored WHERE similarity >= 0.85)) AS files FROM scored WHERE similarity >= 0.85",
    "q_filter_funnel": f"""WITH {_DOCS}, {_SIZES}, {_SIZE_PAIRS}, {_tf()}, {_simhash()}, {_pairs()}, {_scored()},
near AS (SELECT count(*) AS c FROM hashed a JOIN hashed b ON a.id < b.id AND {_NEAR.format(d=10)})
SELECT '1 all' AS stage, (SELECT count(*) * (count(*) - 1) // 2 FROM blocks)::BIGINT AS pairs
UNION ALL SELECT '2 size', sum(c)::BIGINT FROM sized UNION ALL SELECT '3 simhash', c FROM near
UNION ALL SELECT '4 overlap', count(*) FROM pairs UNION ALL SELECT '5 similar', count(*) FROM scored WHERE similarity >= 0.85""",
    "q_ident_split": f"WITH {_IDENTIFIERS} SELECT identifier, (p - 1)::INT AS word_pos, ws[p] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT identifier, {_WORDS.format(x='identifier')} AS ws FROM idents))",
    "q_ident_signature": f"WITH {_IDENTIFIERS} SELECT identifier, {_SIGNATURE.format(x='identifier')} AS signature FROM idents",
    "q_word_index": f"""WITH {_ALL_NAMES}, w AS (SELECT identifier, unnest({_WORDS.format(x='identifier')}) AS word FROM names)
SELECT DISTINCT a.identifier, b.identifier AS candidate FROM w a JOIN w b USING (word)""",
    "q_signature_range": f"""WITH {_ALL_NAMES}, q AS (SELECT identifier, {_SIGNATURE.format(x='identifier')} AS s FROM names)
SELECT q.identifier AS query, c.identifier AS candidate FROM q JOIN q c ON abs(q.s - c.s) <= 64 AND bit_count(xor(q.s, c.s)) <= 6""",
    "q_synonym_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "q_ident_expand": f"WITH {_EXPAND} SELECT identifier, word, round(score, 5) AS score FROM expanded",
    "q_ident_similarity": f"WITH {_EXPAND}, {_ALIKE} SELECT id1, id2, fast, round(similarity, 5) AS similarity FROM compared WHERE id1 < id2",
    "q_two_pass_fuzzy": f"""{_NEAR_DUP}, names AS (SELECT DISTINCT token AS identifier FROM tf), {_EXPANDED}, {_ALIKE},
alike AS MATERIALIZED (SELECT * FROM compared WHERE fast AND similarity >= 0.6),
band AS MATERIALIZED (
  SELECT p.id_a, p.id_b, CASE WHEN a.n < b.n THEN list_has_any(a.toks[1:20], b.toks) ELSE list_has_any(b.toks[1:20], a.toks) END AS ab,
    CASE WHEN b.n < a.n THEN list_has_any(b.toks[1:20], a.toks) ELSE list_has_any(a.toks[1:20], b.toks) END AS ba
  FROM scored p JOIN hashed a ON a.id = id_a JOIN hashed b ON b.id = id_b WHERE similarity >= 0.425 AND similarity < 0.85),
ways AS (SELECT id_a, id_b, id_a AS x, id_b AS y FROM band WHERE ab UNION ALL SELECT id_a, id_b, id_b, id_a FROM band WHERE ba),
mine AS MATERIALIZED (
  SELECT w.*, t.token, t.cnt, t.f, e.f AS same FROM ways w JOIN tf t ON t.id = x LEFT JOIN tf e ON e.id = y AND e.token = t.token),
reach AS MATERIALIZED (SELECT x, y, token, id2, similarity FROM mine JOIN alike ON id1 = token WHERE same IS NULL),
other AS (
  SELECT x, y, r.token, id2, t.f AS g FROM reach r JOIN tf t ON t.id = y AND t.token = id2 JOIN blocks b ON b.id = y
  QUALIFY row_number() OVER (PARTITION BY x, y, r.token ORDER BY similarity DESC, list_position(b.toks, id2)) = 1),
matched AS (SELECT m.*, CASE WHEN same IS NULL THEN id2 ELSE m.token END AS u, coalesce(same, g) AS fu FROM mine m LEFT JOIN other o ON o.x = m.x AND o.y = m.y AND o.token = m.token),
weighed AS (SELECT *, coalesce(1.0 / (1.0 + 2.0 * sqrt(f * fu)), 1.0) AS w FROM matched),
mass AS (SELECT id, sum(cnt * f * f) AS m FROM tf GROUP BY id),
taken AS (SELECT x, y, sum(fu * fu) AS t FROM (SELECT DISTINCT x, y, u, fu FROM weighed WHERE u IS NOT NULL) GROUP BY 1, 2),
totals AS (
  SELECT id_a, id_b, x, y, coalesce(sum(cnt * f * fu * w * w), 0) AS dot, sum(cnt * f * f * w * w) AS a2, coalesce(sum(cnt * fu * fu * w * w), 0) AS b2 FROM weighed GROUP BY ALL),
fuzzy AS (
  SELECT id_a, id_b, max(dot / sqrt(a2 * (b2 + m - coalesce(t, 0)))) AS similarity
  FROM totals q LEFT JOIN taken k ON k.x = q.x AND k.y = q.y JOIN mass ON mass.id = q.y GROUP BY 1, 2)
SELECT id_a, id_b, round(similarity, 6) AS similarity FROM (
  SELECT id_a, id_b, similarity FROM scored WHERE similarity < 0.425 OR similarity >= 0.85 UNION ALL SELECT id_a, id_b, similarity FROM fuzzy)
WHERE similarity >= 0.85""",
    "q_report_json": f"""{_BEST} SELECT to_json({{'file_a': fa, 'file_b': fb, 'similarity': similarity,
  'matches': [{{'file_a_line_start': 1, 'file_a_line_end': na, 'file_b_line_start': 1, 'file_b_line_end': nb}}]}})::VARCHAR AS json FROM best""",
    "q_report_sarif": f"""{_BEST} SELECT to_json({{'ruleId': 'code-duplication', 'level': 'warning',
  'message': {{'text': 'Code duplication detected (' || floor(similarity * 100)::INT || '% similarity)'}},
  'locations': [{_PLACE.format(f="fa")}, {_PLACE.format(f="fb")}]}})::VARCHAR AS json FROM best""",
    "q_path_filter": f"""WITH p AS (SELECT page_id, url, {_PATH} AS path FROM pages),
e AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS extension FROM p)
SELECT page_id, extension, extension IN ({_EXTENSIONS}) AS supported,
  contains(url, '/fr/') OR starts_with(url, 'vendor/') OR starts_with(url, 'http://') OR contains(url, 'https://m.') OR contains(url, '.html') AS ignored,
  regexp_matches(path, '(^|/)\\.[^/]+') AS hidden FROM e""",
}
