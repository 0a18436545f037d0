"""The corpus pipeline: five stages over documents, each stage's rows written as
Parquet and read again by the next.

Stages that pass whole texts through Python ask for small Arrow batches. Their rows
are made when the caller writes them, so a stage called alone leaves that setting in
the session, where it has none; :func:`run` puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, jaccard, language, mixing, secrets
from lodestack.llm._shared import BATCH_ROWS, TEXT_ROWS, scratch, written
from lodestack.llm.queries import RANKS

def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language (null, or no letter) go; ``lang`` of the
    others becomes the predicted one."""
    model = language.fit(docs)
    known = language.predict(docs, model, COLUMNS).where("lang_pred <> 'und'")
    _small_batches(spark)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document with its smallest id
    stays, once: rows that share an id are one document. Rows without an id link
    with nothing and stay."""
    classes = jaccard.near_duplicates(docs)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    kept = docs.join(jaccard._side(written(gone, "pipeline-gone")), "doc_id", "left_anti").select(*COLUMNS)
    side = jaccard._side(twice)
    once = kept.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return kept.join(side, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each span becomes ``[SECRET]``; all documents stay."""
    found = secrets.find_secrets(docs, "text", COLUMNS, masked=True)
    found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("masked"))
    _small_batches(spark)
    return found.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it."""
    sized = docs.withColumn("size", mixing.word_count("text"))
    return mixing.emit(mixing.mix(sized, "doc_id", "size", "source")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, and the digest of what they decode to."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    out = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, "text", ["doc_id", "lang", "source"])
    _small_batches(spark)
    return out.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL cannot express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH_ROWS, None)
    try:
        for i, (_, stage) in enumerate(STAGES):
            with scratch(spark) as result:
                docs = result(stage(spark, docs, sf_dir), f"pipeline-{i}")
    finally:
        if own is None:
            spark.conf.unset(BATCH_ROWS)
    return docs
