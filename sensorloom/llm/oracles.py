"""The queries of this package in SQL, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Checksum of a list of hex byte pairs, by the usual table of the polynomial 0xEDB88320.
_CRC_TABLE = """
    SELECT list_transform(range(256), lambda i: list_reduce(
        [i] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""

ORACLES["op1_sharding"] = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS txt,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         md5(concat_ws(':', '7', doc_id::VARCHAR)) AS h,
         octet_length(encode(coalesce(text, ''))) + 1 AS size,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(
           [4294967295] || list_transform(
             regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) END AS crc32
  FROM documents, crc),
r AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, crc32) - 1 AS rk,
         count(*) OVER (PARTITION BY s) AS n,
         ('0x' || substr(md5(concat_ws(':', '7', 'source', s)), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
  FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (rk + u) / n, s, rk) - 1 AS pos, count(*) OVER () AS total
  FROM r)
SELECT doc_id, size::BIGINT AS size, crc32::BIGINT AS text_crc32, 'rows' AS law,
       (pos * 8 // total)::INTEGER AS shard,
       (pos - ((pos * 8 // total) * total + 7) // 8)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM p
"""

ORACLES["op9_mixing"] = """
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         md5(concat_ws(':', '11', doc_id::VARCHAR)) AS h
  FROM documents),
src AS (
  SELECT s, sum(size)::BIGINT AS n,
         [3, 1, 2][(row_number() OVER (ORDER BY s) - 1) % 3 + 1] AS w
  FROM d GROUP BY s),
lev AS (
  SELECT *, (sum(n) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w::DOUBLE, s
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (ORDER BY 2 * n / w::DOUBLE, s
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM src),
tgt AS (
  SELECT s, n, least((2 * n)::DOUBLE, max(level) OVER () * w) AS target FROM lev),
run AS (
  SELECT d.*, n, target,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2::DOUBLE AS middle
  FROM d JOIN tgt USING (s))
SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
       (size * (CASE WHEN middle <= target THEN 1 ELSE 0 END
              + CASE WHEN middle <= target - n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

ORACLES["op4_lm_score"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
tok AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc),
pair AS (
  SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM tok),
uni AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
uni_own AS (SELECT r, w, count(*) AS c FROM tok GROUP BY r, w),
bi AS (SELECT v, w, count(*) AS c FROM pair WHERE v IS NOT NULL GROUP BY v, w),
bi_own AS (SELECT r, v, w, count(*) AS c FROM pair WHERE v IS NOT NULL GROUP BY r, v, w),
everything AS (SELECT count(*) AS n FROM tok),
one AS (
  SELECT pair.r, pair.v, bi.c - bi_own.c AS both_n, before.c - before_own.c AS context_n,
         log10(greatest(uni.c - uni_own.c, 1) / greatest(everything.n - len(doc.ws), 1)::DOUBLE) AS single
  FROM pair JOIN doc USING (r) CROSS JOIN everything
  JOIN uni ON uni.w = pair.w
  JOIN uni_own ON uni_own.r = pair.r AND uni_own.w = pair.w
  LEFT JOIN uni before ON before.w = pair.v
  LEFT JOIN uni_own before_own ON before_own.r = pair.r AND before_own.w = pair.v
  LEFT JOIN bi ON bi.v = pair.v AND bi.w = pair.w
  LEFT JOIN bi_own ON bi_own.r = pair.r AND bi_own.v = pair.v AND bi_own.w = pair.w),
total AS (
  SELECT r, sum(CASE WHEN v IS NULL THEN single WHEN both_n > 0 THEN log10(both_n / context_n::DOUBLE)
                     ELSE log10(0.4) + single END) AS s
  FROM one GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score,
       round(CASE WHEN len(ws) > 0 THEN s / len(ws) END, 6) AS mean_score
FROM doc LEFT JOIN total USING (r)
"""

ORACLES["op4_lm_score_trigrams"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
tok AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc),
gram AS (
  SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v,
         lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u
  FROM tok),
everything AS (SELECT count(*) AS n FROM tok),
seen AS (
  SELECT *,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS c1,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS c2,
         count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) AS c3
  FROM gram),
context AS (
  SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS b2
  FROM seen),
one AS (
  SELECT context.r, c3, b2, u, v, c2, b1,
         log10(greatest(c1, 1) / greatest(everything.n - len(doc.ws), 1)::DOUBLE) AS single
  FROM context JOIN doc USING (r) CROSS JOIN everything),
two AS (
  SELECT *, CASE WHEN v IS NULL THEN single WHEN c2 > 0 THEN log10(c2 / b1::DOUBLE)
                 ELSE log10(0.4) + single END AS short
  FROM one),
total AS (
  SELECT r, sum(CASE WHEN u IS NULL THEN short WHEN c3 > 0 THEN log10(c3 / b2::DOUBLE)
                     ELSE log10(0.4) + short END) AS s
  FROM two GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score,
       round(CASE WHEN len(ws) > 0 THEN s / len(ws) END, 6) AS mean_score
FROM doc LEFT JOIN total USING (r)
"""


def _crc32(text: str) -> str:
    """The checksum of a text expression; the table stands in ``crc``."""
    return f"""xor(list_reduce([4294967295] || list_transform(
        regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _least(*ways: str) -> str:
    """The least of some ways to a kind of prefix; a way is null where there is none."""
    return f"list_min([{', '.join(ways)}])"


def _way(source: str, cost: str, edit: str, role: str | None = None, text: str = "''", when: str = "true") -> str:
    """A way carried on by one edit, and by a line if a row stays."""
    line = f"{source}.r" if role is None else f"{source}.r || CASE WHEN {source}.r = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    return f"CASE WHEN {source} IS NOT NULL AND {when} THEN {{'c': {source}.c + {cost}, 'a': {source}.a || '{edit}', 'r': {line}}} END"


# The least ways to the four kinds of prefixes, row after row; a way is (cost, audit, lines), compared
# in this order. ``iu`` and ``ia`` are the least ways once rows may have been inserted.
_STAYS = "g.f IN ('', 'truncated')"
_KEEP = {x: f"{_STAYS} AND g.x = '{x}'" for x in "sua"}
_EXTRA = "CASE WHEN g.f = 'truncated' THEN 5 ELSE 0 END"
ORACLES["op13_repair"] = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
kind AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kind WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
given AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN '' ELSE 'truncated' END AS f
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
         count(*) FILTER (f = 'truncated') AS truncated,
         count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM given GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS n,
         NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS u,
         NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS a
  FROM conversations
  UNION ALL
  SELECT w.conv_id, g.i, {_way("w.n", "2", "D")},
         {_least(_way("w.s", "2", "D"), _way("w.n", _EXTRA, "K", "g.role", "g.text", _KEEP["s"]))},
         {_least(
             _way("w.u", "2", "D"),
             *[_way(f"w.{k}", _EXTRA, "K", "g.role", "g.text", _KEEP["u"]) for k in ("n", "s", "ia")],
             *[_way(f"w.{k}", f"1 + {_EXTRA}", "R", "'user'", "g.text", _STAYS) for k in ("n", "s", "ia")],
         )},
         {_least(
             _way("w.a", "2", "D"),
             _way("w.iu", _EXTRA, "K", "g.role", "g.text", _KEEP["a"]),
             _way("w.iu", f"1 + {_EXTRA}", "R", "'assistant'", "g.text", _STAYS),
         )}
  FROM (SELECT *, {_least("a", _way("iu", "5", "I", "'assistant'"))} AS ia FROM (
          SELECT *, {_least("u", *[_way(k, "5", "I", "'user'") for k in ("n", "s", "a")])} AS iu FROM walk)) w
  JOIN given g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1),
ended AS (
  SELECT w.conv_id, i, {_least("n", "a", _way("iu", "5", "I", "'assistant'"))} AS way
  FROM (SELECT *, {_least("u", *[_way(k, "5", "I", "'user'") for k in ("n", "s", "a")])} AS iu FROM walk) w)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, way.c::BIGINT AS cost, way.a AS audit,
       sha256(way.r) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
WHERE e.i = coalesce(n, 0)
"""

ORACLES["op11_prefix_trie"] = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own, any_value({_crc32("conv_id::VARCHAR")}) % 9 AS h
  FROM placed, crc GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS turns
  FROM whole c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefix AS (
  SELECT conv_id, turns, d, turns[1:d] AS key, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT key, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended,
         any_value(CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(turns[d].text)) END) AS size
  FROM prefix GROUP BY key),
children AS (SELECT key[1:d - 1] AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
above AS (
  SELECT key[1:k] AS key, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT node.key, unnest(range(d + 1)) AS k, children.n IS NULL AS leaf, (node.n - 1) * size AS saved
        FROM node LEFT JOIN children USING (key))
  GROUP BY 1)
SELECT node.conv_id, node.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs,
       coalesce(children.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(node.ended) AS ends_sha256
FROM node JOIN above USING (key) LEFT JOIN children USING (key)
LEFT JOIN node parent ON node.d > 0 AND parent.key = node.key[1:node.d - 1]
"""
