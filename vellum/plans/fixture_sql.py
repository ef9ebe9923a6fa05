"""The views of vellum.sources.fixtures in DuckDB SQL, as common table expressions."""

from __future__ import annotations

from ..sources.fixtures import PROFILES

REGIONS = """fx_regions AS (SELECT CAST(l_orderkey AS BIGINT) AS page_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INT) AS region_id,
  CAST((l_partkey * 37) % 700 AS INT) AS x1, CAST((l_suppkey * 53 + l_linenumber * 40) % 1000 AS INT) AS y1,
  CAST(least(800, (l_partkey * 37) % 700 + 12 + (l_partkey * 11) % 240) AS INT) AS x2,
  CAST(least(1200, (l_suppkey * 53 + l_linenumber * 40) % 1000 + 10 + (l_partkey * 17 + l_suppkey) % 420) AS INT) AS y2,
  round(l_discount * 10, 2) AS score, CAST(l_quantity AS INT) AS txt_len, 800 AS img_w, 1200 AS img_h
FROM lineitem)"""

_FIRST = "CAST(2 + (doc_id + k // 2 * 7) % 29 AS INT)"
TEXTS = f"""fx_items AS (SELECT doc_id, k, substr(text, CAST(begin_at AS INT), size) AS t FROM (
  SELECT *, 1 + k // 2 * 512 + CASE WHEN k % 2 = 0 THEN 0 ELSE {_FIRST} END AS begin_at, CASE WHEN k % 2 = 0 THEN {_FIRST} ELSE 512 - {_FIRST} END AS size
  FROM (SELECT doc_id, text, coalesce(length(text), 0) AS n, unnest(range(0, greatest(1, (coalesce(length(text), 0) + 511) // 512) * 2)) AS k FROM documents)) WHERE k = 0 OR begin_at <= n),
fx_texts AS (SELECT doc_id AS page_id, CAST(k AS INT) AS region_id,
  CASE WHEN doc_id % 6 = 5 THEN t
    ELSE translate(lower(t), 'abcdefghijklmnopqrstuvwxyz', CASE doc_id % 6
      WHEN 0 THEN '{PROFILES[0]}' WHEN 1 THEN '{PROFILES[1]}' WHEN 2 THEN '{PROFILES[2]}' WHEN 3 THEN '{PROFILES[3]}' ELSE '{PROFILES[4]}' END) END AS text
FROM fx_items)"""

#: fixtures.placed(): every item with a box of its page.
PLACED = """placed AS (SELECT b.* REPLACE (t.region_id AS region_id), t.text FROM fx_texts t JOIN (SELECT page_id, count(*) AS n FROM fx_regions GROUP BY page_id) c USING (page_id) JOIN {boxes} b ON b.page_id = t.page_id AND b.region_id = t.region_id % c.n)"""

BUBBLES = """fx_bubbles AS (SELECT o.o_orderkey AS page_id, CAST(b.b AS INT) AS bubble_id,
  CAST((o.o_custkey * 29 + b.b * 350) % 600 AS INT) AS x1, CAST((o.o_custkey * 13 + b.b * 500) % 800 AS INT) AS y1,
  CAST(least(800, (o.o_custkey * 29 + b.b * 350) % 600 + 120 + o.o_custkey % 180) AS INT) AS x2,
  CAST(least(1200, (o.o_custkey * 13 + b.b * 500) % 800 + 200 + o.o_custkey % 200) AS INT) AS y2
FROM orders o CROSS JOIN (VALUES (0),(1)) AS b(b))"""

RESPONSES = (
    TEXTS
    + r""", fx_responses AS (SELECT t.page_id, t.region_id, CAST(p.p AS INT) AS provider_rank, CASE p.p WHEN 0 THEN 'p0' ELSE 'p1' END AS provider,
  CASE WHEN (t.page_id + t.region_id + p.p) % 7 = 0 THEN 401 ELSE 200 END AS http_status,
  CASE (t.page_id + t.region_id * 3 + p.p * 2) % 5
    WHEN 0 THEN '' WHEN 1 THEN regexp_replace(t.text, '["\s]', ' ', 'g') WHEN 2 THEN '[TL: missing...]'
    ELSE concat('Line ', CAST(t.page_id AS STRING), ' ', CAST(t.region_id AS STRING)) END AS en_text
FROM fx_texts t CROSS JOIN (VALUES (0),(1)) AS p(p))"""
)


def cnt(col: str, ranges: str) -> str:
    """Characters of col in the ranges."""
    return f"length(regexp_replace({col}, '[^{ranges}]', '', 'g'))"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def squeeze(col: str) -> str:
    return strip(rf"regexp_replace({col}, '\s+', ' ', 'g')")
