"""DuckDB SQL twins of :mod:`labeldist.plans.views`, used as CTE building
blocks by the oracle statements (portable views of FIXTURES.md)."""

from __future__ import annotations

from labeldist import taxonomy as tx



def halves(text: str) -> tuple[str, str]:
    """SQL twin of :func:`labeldist.plans.views.halves`."""
    ls = f"string_split({text}, chr(10))"
    h = f"((len({ls}) + 1) // 2)"
    return (f"nullif(array_to_string({ls}[1:{h}], chr(10)), '')", f"nullif(array_to_string({ls}[{h} + 1:], chr(10)), '')")


V_ITEMS = f"""v_items AS (
  SELECT doc_id AS itemid, lang AS inst_lang,
         CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'dev' ELSE 'test' END AS split,
         {halves('text')[0]} AS arg1,
         {halves('text')[1]} AS arg2
  FROM documents)"""

VOTE_ROWS = """vote_rows AS (
  SELECT user_id AS itemid, CAST((event_id*7919 + user_id*104729) % 29 AS INTEGER) AS l3_idx,
         CAST(event_id % 2 AS INTEGER) AS side
  FROM events)"""

V_VOTES = VOTE_ROWS + """,
v_votes AS (SELECT itemid, l3_idx, side, count(*) AS n FROM vote_rows GROUP BY ALL)"""

V_LITERALS = """v_literals AS (
  SELECT doc_id AS itemid,
         replace(concat('{"s0": 0.', CAST(doc_id%10 AS VARCHAR), ', "s1": 0.', CAST((doc_id*3)%10 AS VARCHAR),
                        ', "norel": 0.', CAST((doc_id*7)%10 AS VARCHAR), '}'), '"', chr(39)) AS dist,
         replace(concat('["', lang, '", "en"]'), '"', chr(39)) AS langs
  FROM documents)"""

V_WIDE = """v_wide AS (
  SELECT doc_id AS itemid,
         CASE WHEN lang='en' THEN text END AS text_en, CASE WHEN lang='de' THEN text END AS text_de,
         CASE WHEN lang='fr' THEN text END AS text_fr, CASE WHEN lang='es' THEN text END AS text_es
  FROM documents)"""

V_LINES = """v_lines AS (
  SELECT doc_id, concat_ws('|',
     CASE WHEN i%11=0 THEN 'EntRel' WHEN i%3=0 THEN 'Explicit' ELSE 'Implicit' END, '', '', '', '', '', '', 'because',
     CASE WHEN i%2=0 THEN 'Contingency.Cause.Reason' ELSE 'Expansion.Conjunction' END, '',
     CASE WHEN i%5=0 THEN 'so' ELSE '' END,
     CASE WHEN i%5=0 THEN 'Contingency.Cause.Result' ELSE '' END, '', '',
     concat(b+i%5, '..', b+i%5+12), '', '', '', '', '',
     concat(b+20, '..', b+25, ';', b+30, '..', b+31+i%7), '') AS line
  FROM (SELECT doc_id, doc_id + k AS i, k * 2000 AS b
        FROM (SELECT doc_id, unnest(range(0, length(coalesce(text, '')) // 2000 + 1)) AS k FROM documents)))"""

V_CLUSTERS = """v_clusters AS (
  SELECT vec_id, label % 4 AS sense,
         (CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE label END) % 4 AS cluster
  FROM embeddings)"""

V_RUNS = """v_runs AS (
  SELECT r.run, c.vec_id, c.label % 4 AS gold,
         (CASE WHEN (c.vec_id + r.run) % 3 = 0 THEN c.vec_id ELSE c.label END) % 4 AS pred
  FROM embeddings c CROSS JOIN (VALUES (1),(2),(3)) AS r(run))"""

V_RESPONSES = """resp_items AS (SELECT DISTINCT user_id AS itemid FROM events),
resp_good AS (
  SELECT itemid, CAST(a.attempt AS INTEGER) AS attempt,
         concat('[', array_to_string(list_transform(range(28), lambda i: CASE WHEN i=itemid%28 THEN '0.7'
                WHEN i=(itemid+9)%28 THEN '0.3' ELSE '0.0' END), ', '), ']') AS good
  FROM resp_items CROSS JOIN (SELECT unnest(range(1, 7)) AS attempt) a),
v_responses AS (
  SELECT itemid, attempt,
         CASE (itemid + attempt) % 7
           WHEN 0 THEN replace(good, '0.7', '0.8')
           WHEN 1 THEN replace(good, ', ', ' ')
           WHEN 2 THEN concat('Answer: ', good)
           WHEN 3 THEN replace(good, '[0.0', '[0')
           WHEN 4 THEN '[0.5, 0.5]'
           ELSE good END AS response
  FROM resp_good)"""


def taxonomy_values() -> str:
    """``tax(l3_idx, l2_idx, l1_idx, l3, l2, l1)`` as an inline VALUES table."""
    rows = []
    for i, name in enumerate(tx.L3_NAMES):
        p2 = tx.L3_PARENT[i]
        p1 = tx.L2_PARENT[p2]
        rows.append(f"({i}, {p2}, {p1}, '{name}', '{tx.L2_NAMES[p2]}', '{tx.L1_NAMES[p1]}')")
    return ("tax AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(l3_idx, l2_idx, l1_idx, l3, l2, l1))")


# Normalised, rolled-up crowd distributions in long form:
# dist(itemid, side, level, idx, p) for every item with at least one vote, and
# the raw counts cdist(itemid, side, level, idx, n).
VOTE_DIST_LONG = VOTE_ROWS + ",\n" + taxonomy_values() + """,
items AS (SELECT DISTINCT itemid FROM vote_rows),
cnt AS (SELECT itemid, side, l3_idx, count(*) AS n FROM vote_rows GROUP BY ALL),
grid AS (
  SELECT i.itemid, s.side, t.l3_idx, t.l2_idx, t.l1_idx, coalesce(c.n, 0) * 1.0E0 AS n
  FROM items i CROSS JOIN (VALUES (0), (1)) s(side) CROSS JOIN tax t
  LEFT JOIN cnt c ON c.itemid = i.itemid AND c.side = s.side AND c.l3_idx = t.l3_idx),
p3 AS (
  SELECT itemid, side, l3_idx, l2_idx, l1_idx,
         CASE WHEN sum(n) OVER w = 0 THEN n ELSE n / sum(n) OVER w END AS p
  FROM grid WINDOW w AS (PARTITION BY itemid, side)),
dist AS (
  SELECT itemid, side, 3 AS level, l3_idx AS idx, p FROM p3
  UNION ALL SELECT itemid, side, 2, l2_idx, sum(p) FROM p3 GROUP BY itemid, side, l2_idx
  UNION ALL SELECT itemid, side, 1, l1_idx, sum(p) FROM p3 GROUP BY itemid, side, l1_idx),
cdist AS (
  SELECT itemid, side, 3 AS level, l3_idx AS idx, n FROM grid
  UNION ALL SELECT itemid, side, 2, l2_idx, sum(n) FROM grid GROUP BY itemid, side, l2_idx
  UNION ALL SELECT itemid, side, 1, l1_idx, sum(n) FROM grid GROUP BY itemid, side, l1_idx)"""


def smoothed(src: str, name: str, keys: str, margin: float = 0.001) -> str:
    """CTE adding the smoothing margin and renormalising within ``keys``."""
    return (f"{name} AS (SELECT *, (p + {margin}) / sum(p + {margin}) OVER "
            f"(PARTITION BY {keys}) AS ps FROM {src})")
