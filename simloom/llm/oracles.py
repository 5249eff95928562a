"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from simloom.llm.url_filter import CONTRACT_RULES, DEFAULT_GLOBS

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line,
         translate(trim(parts[i], {_BLANKS}), {_AZ}) AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keep AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k),
words AS (
  SELECT doc_id, pos // 64 AS w, xor(bit_or(1::UBIGINT << (pos % 64)::UBIGINT), 18446744073709551615) AS bits
  FROM marked WHERE gone GROUP BY ALL),
maps AS (
  SELECT doc_id, string_agg(w || ':' || lower(to_hex(bits)), ',' ORDER BY w) AS kept_words
  FROM words GROUP BY doc_id)
SELECT m.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256,
       coalesce(any_value(kept_words), '') AS kept_words
FROM marked m LEFT JOIN maps USING (doc_id) GROUP BY m.doc_id
"""


#: The kinds of secrets: name, pattern, group that counts, its least size. The first three are the base.
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
    ("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    ("slack", r"(xox[baprs]-[A-Za-z0-9-]+)", 1, 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+)", 1, 30),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27),
)


def _spans_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS ord, '{kind}' AS kind, n, s, s + w AS e FROM (
    SELECT doc_id, n, w, sum(b) OVER up_to + sum(w) OVER up_to - w AS s FROM (
      SELECT doc_id, unnest(range(1, len(whole) + 1)) AS i,
             length(pieces[i]) AS b, length(whole[i]) AS w, length(counted[i]) AS n
      FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces,
                   regexp_extract_all(text, '{pattern}') AS whole,
                   regexp_extract_all(text, '{pattern}', {group}) AS counted
            FROM docs))
    WINDOW up_to AS (PARTITION BY doc_id ORDER BY i))
  WHERE n >= {least}"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words joined by blanks: a window occurs where its words do, between blanks.
DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x USING (n, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BASE = [s[0] for s in SECRETS[:3]]
_KINDS = ", ".join(f"'{k}'" for k in _BASE)
_COUNTS = ", ".join(f"(count(*) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in _BASE)
SECRET_SCAN = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(i, *r) for i, r in enumerate(SECRETS))})
SELECT d.doc_id, {_COUNTS},
  sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (kind IN ({_KINDS})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord), '') AS spans
FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '{slash}{path}'))"


_RANKED = sorted(CONTRACT_RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
_RULE = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _RANKED)
_VERDICT = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in CONTRACT_RULES)
_GLOBS = " OR ".join(f"('.' || host || path) GLOB '{g}'" for g in DEFAULT_GLOBS)
URL_FILTER = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {_RULE} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {_VERDICT} WHEN host || path <> '' AND ({_GLOBS}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

ORACLES: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP,
    "op8_decontamination": DECONTAMINATION,
    "op9_secret_scan": SECRET_SCAN,
    "op10_url_filter": URL_FILTER,
}
