"""The registered queries on ``documents`` fingerprints and ``conversations``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import conversation_repair, prefix_trie, simhash
from ledgerline.session import table

_COLUMNS = ("conv_id", "turn", "role", "text")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.with_all(rows, "conv_id", conversation_repair.repair(
        conversation_repair.damage(rows, *_COLUMNS)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"), *_COLUMNS)
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII string, bit by bit."""
    bits = ", ".join(["-1"] * 8)
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''),
      lambda ch: [ascii(ch)::BIGINT, {bits}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
      ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


def _step(state: int) -> str:
    """The cheapest of delete, keep and re-role for the current row, before any insert."""
    to = conversation_repair.NEXT[state]
    kept = " ".join(f"WHEN '{k}' THEN v{v[state]}" for k, v in conversation_repair.AFTER.items() if state in v)
    row, extra = "r.role || ':' || r.text", "CASE WHEN r.fault = 't' THEN 3 ELSE 0 END"
    role = conversation_repair.NEXT_ROLE[state]
    return f"""list_sort(list_concat([{{'c': v{state}.c + 4, 'a': 'D' || v{state}.a, 'r': v{state}.r}}],
      CASE WHEN r.fault IN ('b', 'd') THEN [] ELSE
        [{{'c': v{to}.c + 3 + {extra}, 'a': 'R' || v{to}.a, 'r': list_prepend('{role}:' || r.text, v{to}.r)}}] END,
      CASE WHEN r.fault IN ('b', 'd') OR (CASE left(r.role, 1) {kept} END) IS NULL THEN [] ELSE
        list_transform([CASE left(r.role, 1) {kept} END],
          lambda k: {{'c': k.c + {extra}, 'a': 'K' || k.a, 'r': list_prepend({row}, k.r)}}) END))[1]"""


def _insert(state: int, after: str) -> str:
    role = conversation_repair.NEXT_ROLE[state]
    return f"list_sort([w{state}, {{'c': {after}.c + 3, 'a': 'I' || {after}.a, 'r': list_prepend('{role}:', {after}.r)}}])[1]"


REPAIR_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last
  FROM (SELECT conv_id, turn, role, text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
r AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd'
         WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         CASE WHEN i > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)
           NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal
  FROM numbered),
per AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, sum(illegal)::BIGINT AS illegal
  FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS v0,
         {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS v1, {{'c': 3, 'a': 'I', 'r': ['assistant:']}} AS v2,
         {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS v3 FROM per
  UNION ALL
  SELECT conv_id, i, {_insert(0, "u")} AS v0, {_insert(1, "u")} AS v1, u AS v2, {_insert(3, "w2")} AS v3
  FROM (SELECT *, {_insert(2, "w3")} AS u FROM (
    SELECT dp.conv_id, dp.i - 1 AS i, {", ".join(f"{_step(s)} AS w{s}" for s in range(4))}
    FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.i = dp.i - 1)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN per USING (conv_id)
LEFT JOIN (SELECT conv_id, v0 FROM dp WHERE i = 1) USING (conv_id)
"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         [coalesce(role, ''), coalesce(text, '')] AS x FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, x FROM convs c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, x FROM convs c JOIN t ON t.conv_id = c.conv_id AND i > h),
whole AS (
  SELECT conv_id, coalesce(list(x ORDER BY part, i) FILTER (x IS NOT NULL), []) AS s
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
prefix AS (SELECT conv_id, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth FROM whole),
named AS (SELECT conv_id, n, depth, sha256(s[1:depth]::VARCHAR || depth) AS node,
                 CASE WHEN depth > 0 THEN sha256(s[1:depth - 1]::VARCHAR || (depth - 1)) END AS parent,
                 CASE WHEN depth > 0 THEN octet_length(encode(s[depth][2])) ELSE 0 END AS bytes FROM prefix),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM named GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
lines AS (  -- each node under each of its prefixes
  SELECT DISTINCT a.node AS top, b.node FROM named a JOIN named b USING (conv_id) WHERE b.depth >= a.depth),
under AS (
  SELECT top AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM lines JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON p.node = a.parent LEFT JOIN children c ON c.node = a.node JOIN under u ON u.node = a.node
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {"op12_conversation_repair": REPAIR_SQL, "op13_prefix_trie": TRIE_SQL}
