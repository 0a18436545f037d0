"""The registered queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import ann, bpe, embed_dedup, jaccard, language, mixing, quality, secrets, toxicity, warc
from lodestack.llm._shared import written, written_texts

#: The rank file of the tokenizer; any path with the same format will do.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "mixing-sizes")
    return mixing.mix(sized, "doc_id", "size", "source").select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, "text", ["doc_id"])
    out = out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return written_texts(out, "bpe-digests")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_texts(secrets.digest_columns(secrets.find_secrets(_table(spark, sf_dir, "documents"), "text", ["doc_id"]), "doc_id"), "secrets-digests")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_columns(warc.roundtrip(_table(spark, sf_dir, "pages")))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_texts(toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "toxicity-scores")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources; paths are languages under a source."""
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_texts(language.identify(_table(spark, sf_dir, "documents")), "language-scores")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_mixing, op2_bpe, op3_ann, op4_secrets, op5_warc, op6_embed_dedup, op7_toxicity, op8_quality, op9_jaccard, op10_language)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (count(*) + {mixing.CELL - 1}) // {mixing.CELL} AS k, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS i
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(i % 3 + 1)::INT]::BIGINT AS weight, (SELECT 3 * sum(source_size) FROM s)::BIGINT AS budget2 FROM s
), caps AS (
  -- in the order in which sources reach their cap
  SELECT *, sum(source_size) OVER o AS size_before, sum(weight) OVER o AS weight_before
  FROM w WINDOW o AS (ORDER BY source_size::HUGEINT * 1000000000000 // weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT *, budget2 - 4 * coalesce(size_before, 0) AS left2, (SELECT sum(weight) FROM w) - coalesce(weight_before, 0) AS left_weight FROM caps
), free AS (
  SELECT min_by(left2, (source_size::HUGEINT * 1000000000000 // weight, i)) AS left2, min_by(left_weight, (source_size::HUGEINT * 1000000000000 // weight, i)) AS left_weight
  FROM level WHERE NOT (weight::HUGEINT * left2 > 4::HUGEINT * source_size * left_weight)
), t AS (
  SELECT l.source, l.i, l.k, l.source_size,
    CASE WHEN l.source_size = 0 THEN 0 WHEN l.weight::HUGEINT * f.left2 > 4::HUGEINT * l.source_size * f.left_weight THEN 2 * l.source_size ELSE l.weight * f.left2 END AS num,
    CASE WHEN l.source_size = 0 OR l.weight::HUGEINT * f.left2 > 4::HUGEINT * l.source_size * f.left_weight THEN 1 ELSE 2 * f.left_weight END AS den
  FROM level l, free f
), r AS (
  SELECT *, num::DOUBLE / den::DOUBLE AS target, CASE WHEN source_size = 0 THEN 0 ELSE (num::HUGEINT * {1 << mixing.BITS} // (den::HUGEINT * source_size))::BIGINT END AS rate,
    ('0x' || substr(md5('mix:' || i), 1, 7))::BIGINT AS u FROM t
), p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.u,
    row_number() OVER (PARTITION BY r.i ORDER BY length(bin(d.size)), ('0x' || substr(md5(concat_ws(':', d.doc_id::VARCHAR, d.size::VARCHAR)), 1, 8))::BIGINT % r.k, d.size, d.doc_id NULLS FIRST) AS pos
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  ((pos * rate + u) // {1 << mixing.BITS} - ((pos - 1) * rate + u) // {1 << mixing.BITS})::BIGINT AS copies,
  ((pos * rate + u) // {1 << mixing.BITS} - ((pos - 1) * rate + u) // {1 << mixing.BITS})::BIGINT * size AS taken
FROM p
"""

_OP5 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""

_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles FROM w
), n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n na ON na.doc_id = o.a JOIN n nb ON nb.doc_id = o.b WHERE 100 * o.both >= 75 * (na.n + nb.n - o.both)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM n
  UNION
  SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.other) AS component_id FROM n JOIN reach ON reach.node = n.doc_id GROUP BY 1, 2
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op5_warc": _OP5, "op6_embed_dedup": _OP6, "op9_jaccard": _OP9}
