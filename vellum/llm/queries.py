"""Queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .centroids import op13_centroid_clustering
from .chat_format import op1_chat_format
from .divergence import op12_source_divergence
from .mixing import op4_mixing
from .posting_lists import op11_nearest_neighbours
from .quality_classifier import op6_quality_classifier
from .quality_rules import op5_quality_rules
from .sharding import op10_sharding
from .simhash import op7_simhash
from .substring_dedup import op9_substring_dedup
from .topk_search import op3_topk_search
from .warc import op2_warc

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_warc": op2_warc,
    "op3_topk_search": op3_topk_search,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_ODD = "'</s>[INST] ok [/INST]'"
_CONTROLS = r"'</?s>|\[/?INST\]'"


def _escaped(c: str) -> str:
    """Length of a text after escaping: a backslash more for each backslash and control string."""
    return rf"(length({c}) + len(regexp_extract_all({c}, '\\')) + len(regexp_extract_all({c}, {_CONTROLS})))"


_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def _clustered(rounds: int = 10) -> str:
    """Rounds of exact centroid clustering as one common table expression after another; x is a vector's components by place."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM v QUALIFY j < 8)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)""")
        steps.append(f"""s{r} AS (SELECT j, i, CAST(sum(x)::HUGEINT // count(*) AS BIGINT) - CASE WHEN sum(x) < 0 AND sum(x)::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END AS m FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY i) AS c FROM s{r} GROUP BY j) n ON n.j = c{r}.j)""")
    return "WITH " + ",\n".join(steps[:-2]) + f"""
SELECT vec_id, CAST(a.j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


#: For the operators that SQL can express. The others hash, encode, train or draw; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_ODD}), (-7, 1, 'assistant', {_ODD}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(9 + {_escaped("role")} + {_escaped("text")} + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, strlen(html) AS bytes FROM p),
k AS (SELECT page_id, bytes AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to,
  lower(concat(array_to_string(list_reverse(string_split({_HOST}, '.')), ','), ')', {_PATH}, CASE WHEN {_QUERY} <> '' THEN concat('?', array_to_string(list_sort(string_split({_QUERY}, '&')), '&')) ELSE '' END)) AS urlkey,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM f)
SELECT *, row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS index_pos FROM k""",
    "op3_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INT) AS rank, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 QUALIFY rank <= 20""",
    "op9_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d), h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM s),
r AS (SELECT doc_id, list(i) AS starts FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 35)))) AS gone FROM r),
k AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS i FROM d JOIN c USING (doc_id)), g AS (SELECT doc_id, unnest(gone) AS i FROM c),
x AS (SELECT k.doc_id, coalesce(string_agg(k.w[k.i], ' ' ORDER BY k.i) FILTER (g.i IS NULL), '') AS kept, count(g.i) AS n FROM k LEFT JOIN g USING (doc_id, i) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(x.n, 0) AS n_removed, sha256(coalesce(x.kept, array_to_string(d.w, ' '))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)""",
    "op12_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL), sl AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL), tl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, tl.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (tl.n + 5)) // (sl.n + 5 * v.v) AS q
  FROM g JOIN tl ON tl.lang = g.lang JOIN v ON v.lang = g.lang JOIN sl ON sl.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = tl.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x QUALIFY part = 'pair' OR rank <= 50""",
    "op13_centroid_clustering": _clustered(),
}
