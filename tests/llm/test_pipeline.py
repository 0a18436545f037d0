"""The pipeline, stage by stage, against a plain version on a small corpus."""

import importlib
import random

import pytest

from lodestack.llm import bpe, mixing, secrets
from tests.llm.test_pairs import brute, corpus


def test_pipeline_equals_plain_version(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in corpus(7, 120)]
    rows.append((400, "quite another text that holds a password = hunter2222 in it", "en", "a", 60))
    rows += [(500, None, "en", "a", None), (501, "!!! 123", "en", "a", 7), (502, rows[5][1], "en", "b", 1), (502, rows[5][1], "en", "b", 1), (503, "a text of its own without a known language", None, "b", 1)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int").write.parquet(str(path))
    out = pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    comp = brute([(r[0], r[1]) for r in kept])
    once = {r[0]: r for r in kept if comp[r[0]] == r[0]}
    masked = [(i, secrets.mask(r[1], secrets.scan(r[1])), r[3]) for i, r in once.items()]
    assert [t for i, t, _ in masked if i == 400 and "[SECRET]" in t]
    df = spark.createDataFrame(masked, "doc_id long, text string, source string").withColumn("n", mixing.word_count("text"))
    copies = {(r.doc_id, r.text): r.copies for r in mixing.mix(df, "doc_id", "n", "source").collect()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = bpe._Encoder(ranks, public_tokenizers.PATTERN)
    want = sorted((i, enc(t)) for i, t, _ in masked for _ in range(copies[i, t]))
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == want
    assert {r.lang for r in out} == {"en"}
