"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embed_dedup, lexical, packing, pii, quality, setjoin, token_counts, topk, url_filter, warc, whitening
from .common import prepare, table, written

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(prepare(spark), sf_dir, name))


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.quantized(table(prepare(spark), sf_dir, "embeddings")), "quantized")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    return url_filter.judge(pages, url_filter.mobile_hosts(pages))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts hold marks of common templates.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(told.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_round_trip": _on("documents", bpe.token_digests),
        "op2_exact_top_k": _top_k,
        "op3_token_counts": _on("documents", token_counts.token_counts),
        "op4_personal_data": _on("documents", pii.personal_data),
        "op5_embedding_near_dedup": _on("embeddings", embed_dedup.near_duplicates),
        "op6_packing": _on("documents", packing.pack_documents),
        "op7_jaccard_join": _on("documents", setjoin.jaccard_components),
        "op8_ordinal_quality": _quality,
        "op9_warc_round_trip": _on("pages", warc.archive_round_trip),
        "op10_url_filter": _urls,
        "op11_lexical_search": _lexical,
        "op12_embedding_whitening": _on("embeddings", whitening.whitened),
        "op13_chat_format": _chat,
    }


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """Recursive CTEs: ``reach`` has every node's smallest reachable node."""
    return f"""walk(id, r) AS (
  SELECT id, id FROM ({nodes})
  UNION
  SELECT l.b, w.r FROM walk w JOIN ({links}) l ON l.a = w.id WHERE w.r < l.b),
reach AS (SELECT id, min(r) AS component FROM walk GROUP BY id)"""


def _terms(text: str) -> str:
    """The terms of a text as a list."""
    return (
        rf"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        rf"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    )


def oracle_sql() -> dict[str, str]:
    probe = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return {
        "op2_exact_top_k": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE {_USABLE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
        "op5_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{_components("SELECT vec_id AS id FROM embeddings", "SELECT * FROM links")},
c AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT t.vec_id, coalesce(c.n_links, 0) AS n_links, r.component AS component_id, t.vec_id = r.component AS kept
FROM embeddings t JOIN reach r ON t.vec_id = r.id LEFT JOIN c ON c.a = t.vec_id""",
        "op7_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
                             lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS s FROM w),
d AS (SELECT DISTINCT doc_id, unnest(s) AS item FROM g),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
u AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.item = b.item AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)),
i AS (SELECT u.a, u.b, count(*) AS k FROM u JOIN d p ON p.doc_id = u.a JOIN d q ON q.doc_id = u.b AND q.item = p.item GROUP BY u.a, u.b),
links AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
{_components("SELECT doc_id AS id FROM documents", "SELECT * FROM links")}
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, r.component AS component_id
FROM documents t JOIN reach r ON r.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id""",
        "op9_warc_round_trip": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND page_id < first THEN first END AS refers_to
FROM f""",
        "op10_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce({_HOST}, '') AS host,
             coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
m AS (SELECT h.page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(rule_verdict, length(rule_host || rule_path)) AS v
      FROM h JOIN r ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, CASE WHEN h.host LIKE 'm.%' THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id""",
        "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, s GROUP BY term),
f AS (SELECT q.item_id, t.r, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * s.docs) // s.total)))) AS BIGINT) AS score
      FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term, s GROUP BY q.item_id, t.r, t.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""",
        "op13_chat_format": rf"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {probe}),
t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a),
l AS (SELECT *, length(role) + 2 * len(regexp_extract_all(role, '[%>\n]')) AS role_chars, length(text) + len(regexp_extract_all(text, '<\\*/?turn')) AS text_chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(6 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id, own""",
    }
