"""The contract's queries, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontaminate, fim, html, langid, minhash, pii, shard, simhash, suffixtree, topk, urlfilter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shards(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op9_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scores(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (op1_topk, op2_pii, op3_html, op4_urlfilter, op5_minhash, op6_decontaminate, op7_shard, op8_langid, op9_suffixtree, op10_bpe, op11_simhash, op12_centroids, op13_fim)
    return {f.__name__: f for f in every}


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TOPK = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
      FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
      FROM w, unnest(range(1, greatest(len(ws), 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.root, e.y FROM r JOIN e ON r.node = e.x),
b AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, b.component_id,
       d.doc_id = b.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN b USING (doc_id)
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[j:j + 9], ' ') AS win FROM i, unnest(range(1, greatest(len(ws) - 8, 2))) AS u(j) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM p),
o AS (SELECT doc_id, j, k, array_to_string(ws[j:j + k - 1], ' ') AS win FROM d, ks, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS u(j)),
m AS (SELECT o.doc_id, o.j, o.k, p.item_id FROM o JOIN p ON o.win = p.win AND o.k = p.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, j, k FROM m), unnest(range(j, j + k)) AS u(q) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS us,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds over all rows, one component a row, with means floored in integers."""
    parts = [
        "WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, i, v[i] AS c FROM e, unnest(range(1, 65)) AS t(i))",
        f"o AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k FROM e QUALIFY k < {k})",
        "m0 AS MATERIALIZED (SELECT k, i, c FROM o JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, k, sum((x.c - m.c) * (x.c - m.c))::BIGINT AS d FROM x JOIN m{n} m USING (i) GROUP BY r, k)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT k, i, sum(c)::BIGINT AS s, count(*)::BIGINT AS q FROM a{n} JOIN x USING (r) GROUP BY k, i)")
            parts.append(f"m{n + 1} AS MATERIALIZED (SELECT m.k, m.i, CASE WHEN s IS NULL THEN m.c ELSE (s - ((s % q) + q) % q) // q END AS c FROM m{n} m LEFT JOIN s{n} USING (k, i))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS sha FROM m{rounds} GROUP BY k)")
    return (
        ", ".join(parts)
        + f" SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN e USING (r) JOIN h USING (k)"
    )


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express."""
    return {"op12_centroids": _clusters(), "op13_fim": _MIDDLE, "op1_topk": _TOPK, "op4_urlfilter": urlfilter.oracle(), "op5_minhash": _NEAR, "op6_decontaminate": _LEAKS}
