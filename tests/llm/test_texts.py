"""Operators on single texts, held against brute force, round trips and accuracy."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, language, mixing, quality, secrets, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    None, "", " ", "a", "Hello world, it's 12345 o'clock!", "  two  spaces \n\n lines\t\ttabs ", "Überraschung für naïve façade çé", "日本語テキスト と emoji 🙂🙂👩‍👩‍👧",
    "x" * 5000, "ab" * 700, "".join(chr(97 + i * i % 26) for i in range(900)), "'s't're's I'll you've", "\x1c\x1d\x85  odd spaces ﻿", "word " * 30_000, "<|endoftext|>", "\x00\x01",
]


def docs(spark, texts, extra=("ids binary", b"x")):
    return spark.createDataFrame([(i, t, extra[1]) for i, t in enumerate(texts)], f"doc_id long, text string, {extra[0]}")


def test_bpe_equals_tiktoken_and_decodes(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, [*TEXTS, TEXTS[4]])
    out = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN, "text", ["doc_id"]), ranks).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        t = [*TEXTS, TEXTS[4]][r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
    both = bpe.round_trip(df, ranks, public_tokenizers.PATTERN, "text", ["doc_id"])
    assert sorted(map(tuple, both.collect())) == sorted((r.doc_id, r.ids, r.decoded) for r in out)
    assert bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN, "text", ["doc_id"]).count() == 0
    bad = spark.createDataFrame([(None,), (bytes(3),), (b"\xff\xff\xff\xff",), (bytes(4),)], "ids binary")
    assert [r.decoded for r in bpe.decode(bad, ranks).collect()][:3] == [b"", None, None]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None


def test_bpe_forgets_and_merges_long_words(monkeypatch):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    monkeypatch.setattr(bpe, "CACHE", 3)
    enc = bpe._Encoder(ranks, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(60):
        t = " ".join("".join(rng.choice("etaoinü") for _ in range(rng.choice([3, 9, 63, 64, 65, 200]))) for _ in range(8))
        assert np.frombuffer(enc(t), "<u4").tolist() == own.encode_ordinary(t)


def test_bpe_fold_in_higher_order_functions(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [" the", "thererest", "ü", " naïve", "日本", "a", "12345", "!!!!", " unbelievably"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_words(F.col("w"), ranks).alias("ids")).collect()
    assert all(r.ids == bpe.merge_word(r.w.encode(), ranks) for r in got)


BASE = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute_spans(text):
    out = []
    for k, (name, (p, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), k, m.end(), name) for m in p.finditer(text or "") if m.end(group) - m.start(group) >= least]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


def test_secrets_after_a_path_are_found():
    for secret in ("T01ABCDEF/B02GHIJKL/q7Xz4Rk9Lm2Np8Vt5Wy1Bc3D", "q7Xz4Rk9Lm2Np8Vt5Wy1Bc3DzH6tKs0f", "Xz4Rk9-Lm2Np8-Vt5Wy1-Bc3DzH"):
        for path in ("com/services/", "api/v1/", "hooks/main/v2/"):
            text = f"see https://x.example.{path}{secret} there"
            assert secret[-20:] not in secrets.mask(text, secrets.scan(text))
    rng = random.Random(4)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=40)) for _ in range(20_000)]
    assert sum(secrets.allowed(k) for k in keys) <= 40  # those without a digit
    for clean in ("docs/guide/getting-started-with-tables-2024", "usr/lib/python3/dist-packages/numpy/core", "api/v1/users/settings/profile"):
        assert secrets.scan(f"see {clean} here") == []


def test_secrets_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", ": ", " = ", "=", '"', "'", " ", "\n", "AKIA", "AKIA" + "X7" * 8, "AKIA" + "Z" * 15, "deadbeef" * 3, "deadbeef" * 2 + "cafebab", "abc", "hunter2", "hunter22", "é", "🙂", "a1b2c3d4e5", "/", "Kſ", "tok", "en"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "secret: token: abcdefgh", "x" * 100_000, "passWord='" + "Ab3+" * 5000]
    rows = secrets.find_secrets(docs(spark, texts, ("spans int", 1)), "text", ["doc_id"], masked=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == brute_spans(texts[r.doc_id])
        assert (r.masked is None) == (texts[r.doc_id] is None)
    digest = secrets.digest_columns(secrets.find_secrets(docs(spark, texts, ("spans int", 1)), "text", ["doc_id"]), "doc_id").collect()
    assert all(r.base_sha256 == hashlib.sha256(",".join(brute_spans(texts[r.doc_id])).encode()).hexdigest() for r in digest)


def test_entropy_finds_random_keys_and_leaves_words():
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    assert any(secrets.KINDS[k] == "entropy_base64" for _, k, _ in secrets.scan(f"key is {key} there"))
    assert "[SECRET]" in secrets.mask(f"key is {key} there", secrets.scan(f"key is {key} there"))
    for clean in ("internationalisierungsbehoerde", "550e8400-e29b-41d4-a716-446655440000", "path/to/some/file/name", "=" * 80, "12345678901234567890123"):
        assert secrets.scan(f"see {clean} here") == []


def test_entropy_counts_equal_recomputation():
    rng = random.Random(4)
    for _ in range(50):
        s = "".join(rng.choice("abc123XYZ") for _ in range(rng.randrange(15, 60)))
        want = set()
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            h = -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
            if h >= 2.9 - 1e-9 and any(map(str.isdigit, w)) and any(map(str.isalpha, w)):
                want |= set(range(i, i + 20))
        assert {x for a, b in secrets.entropy_runs(s, 2.9) for x in range(a, b)} == want


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 80))), rng.choice(["b", "a", "a", "a", "é", None, "tiny"]), 1) for i in range(3000)]
    rows = [(i, t, "a" if s == "tiny" and i > 60 else s, x) for i, t, s, x in rows] + [(7, "same row", "a", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").withColumn("n", mixing.word_count("text"))
    out = mixing.mix(df, "doc_id", "n", "source").collect()
    assert len(out) == len(rows)
    total = sum(r.n for r in out)
    per = {}
    for r in out:
        per.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, [3, 1, 2, 3, 1, 2]))
    left, free, cap = 1.5 * total, set(order), {}
    while over := [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * per[s][1]]:
        for s in over:
            cap[s] = 2 * per[s][1]
        free -= set(over)
        left = 1.5 * total - sum(cap.values())
    for s in order:
        target = cap.get(s, left * w[s] / sum(w[x] for x in free) if free else 0)
        assert per[s][0] == pytest.approx(target)
        assert abs(per[s][2] - target) <= max(0.03 * target, 100)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7), "doc_id", "n", "source").select(out[0].__fields__).collect()))
    assert mixing.emit(mixing.mix(df, "doc_id", "n", "source")).count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0), "doc_id", "n", "source").count() == 0


def test_mixing_of_many_sources_equals_that_of_few(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 400, rng.choice([None, *(f"s{j}" for j in range(40))]), rng.choice([0, 1, 5, 40])) for i in range(900)]
    rows += [(None, "big", 3)] * 50 + [(i, "big", 30) for i in range(900)] + [(1, "zero", 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, n int, __mix_i int")
    few = sorted(map(str, mixing.mix(df, "doc_id", "n", "source").collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    monkeypatch.setattr(mixing, "BLOCK", 1)
    assert sorted(map(str, mixing.mix(df, "doc_id", "n", "source").collect())) == few and "__mix_i=7" in few[0]


def test_warc_archives_are_bounded_and_resolve(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CLASSES", [1000, 10_000, 40_000])
    rows = [(i, f"http://a/{i}", random.Random(i % 37).choice("xyz") * random.Random(i % 37).choice([50, 900, 9_000, 30_000, 90_000])) for i in range(90)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert sorted(sizes)[-1] < 95_000 and sum(n > 42_000 for n in sizes) <= sum(len(r[2]) == 90_000 for r in rows)
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse_warc(f.read_bytes())]
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == len(heads) == 270
    asked = [h["warc-refers-to"] for h in heads if "warc-refers-to" in h]
    assert asked and set(asked) <= ids


def test_warc_round_trip(spark):
    big = "<p>" + "é🙂" * 100 + "</p>"
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (4, "http://b", "small"), (2, "http://b", "small"), (1, "u v\r\nWARC/1.1", None), (7, "x", ""), (8, "y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (3, "http://a/2", big), (None, "z", big)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")
    out = warc.capture_columns(warc.roundtrip(df)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    want = []
    for i, _, t in rows:
        d = (t or "").encode()
        first = min((j for j, _, u in rows if u == t and j is not None), default=None)
        again = len(d) >= 100 and i is not None and first < i
        want.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_warc_reads_gzip_members_and_assembles(spark, tmp_path):
    import gzip

    rec = lambda kind, rid, to, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "") + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    parts = [rec("warcinfo", "<i>", None, b"software: x"), rec("response", "<r>", None, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), rec("request", "<q>", "<r>", b"GET / HTTP/1.1\r\n\r\n"), rec("request", "<lost>", "<none>", b"GET /")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    out = warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()
    assert len(out) == 1 and bytes(out[0].response.payload) == b"body" and out[0].request.id == "<q>" and out[0].metadata is None


def corpus(rng, n):
    vocab = {"en": "the of and to in is that for it was".split(), "de": "der die das und ist ein eine mit zu von".split(), "fr": "le la les de des et un une est dans".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        words = [rng.choice(vocab[lang]) if rng.random() < 0.5 else "".join(rng.choice("aeinrst" + {"en": "why", "de": "äßk", "fr": "éèx"}[lang]) for _ in range(5)) for _ in range(rng.randrange(20, 90))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "clown"])
        good = int(rng.random() < 0.7)
        if not good:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), lang, f"s{rng.randrange(6)}" if good else f"s{rng.randrange(5, 8)}", toxic, good))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus(random.Random(9), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int, quality int")
    return df.select("doc_id", "text", "lang", "source").cache(), df.select("doc_id", "quality", "toxic").cache(), {r[0]: r for r in rows}


def odd(spark):
    return spark.createDataFrame([(5000, None, "en", None, 1), (5001, "", None, "s1", 1), (5002, "12 34 !!", "de", "s1", 1), (5003, "the of " * 20_000, "en", "s1", 1), (None, "the of", None, None, 1), (5003, "the of " * 20_000, "en", "s1", 1)], "doc_id long, text string, lang string, source string, score int")


def test_language_held_out_accuracy(spark, labelled):
    docs_, _, rows = labelled
    out = [r for r in language.identify(docs_).collect() if r.held_out]
    assert len(out) > 200 and sum(r.lang_pred == rows[r.doc_id][2] for r in out) / len(out) > 0.95
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd(spark), language.fit(docs_), ["doc_id"]).collect()}
    assert {(5000, "und"), (5001, "und"), (5002, "und"), (5003, "en")} <= got
    assert {r.lang_pred for r in language.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs_.limit(0)).count() == 0


def test_language_votes_equal_plain_ones(labelled):
    rows = list(labelled[2].values())[:240]
    texts, langs = [r[1] for r in rows], [["en", "de", "fr", "es", "nl"][i % 5] if i % 3 else r[2] for i, r in enumerate(rows)]
    model = language.train(texts, langs)
    x = language.features(texts)
    got, score = model.predict(x)
    for row, lang in zip(x, got):
        row = [*row.tolist(), 1.0]
        dot = lambda w: sum(a * b for a, b in zip(row, w.tolist()))
        fam = max(range(len(model.families)), key=lambda f: dot(model.family_w[:, f]))
        names = model.languages[fam]
        votes = dict.fromkeys(names, 0)
        for a, b, w in model.pairs[fam]:
            p = 1 / (1 + np.exp(-4 * dot(w)))
            votes[names[a]] += (p >= 0.5) + 1e-3 * p
            votes[names[b]] += (p < 0.5) + 1e-3 * (1 - p)
        assert lang == max(names, key=lambda n: votes[n])
    assert all(language.family(n) == f for f, ns in zip(model.families, model.languages) for n in ns) and all(0 <= v <= 1 for v in score)


def test_language_features_count_trigrams():
    def bucket(tri):
        b = [int(c) for c in tri]
        return ((b[0] * 2654435761 + b[1] * (40503 * 65536 + 1) + b[2] * 2246822519) % 2**32) >> 20

    text = "Der Äpfel, 12 fiel weit"
    data = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in f" {text.lower()} ".encode())
    want = np.zeros(language.FEATURES)
    for i in range(len(data) - 2):
        if data[i : i + 2] != b"  ":
            want[bucket(data[i : i + 3])] += 1
    want = np.sqrt(want)
    assert np.allclose(language.features([text])[0], want / np.linalg.norm(want), atol=1e-6)


def test_language_of_many_labels(spark, monkeypatch):
    rows = [(i, f"text of the label {'xyzuvw'[i % 6] * 4} {i % 11}", f"junk{i % 250}" if i % 2 else ["en", "de"][i % 4 // 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LANGUAGES", 30)
    model = language.fit(df)
    names = [n for g in model.languages for n in g]
    assert len(names) == 30 and {"en", "de"} <= set(names)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 2_000)
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(texts))
    language.fit(df)
    assert 0 < sum(map(len, seen[0])) <= 2_000


def test_language_families():
    assert language.family("en-GB") == language.family("de") != language.family("fr") and language.family("xx") == "only xx"


def test_toxicity_held_out_accuracy(spark, labelled):
    docs_, labels, rows = labelled
    out = [r for r in toxicity.toxicity(docs_, labels).collect() if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][4] for r in out) / len(out) > 0.93
    model = toxicity.fit(docs_, labels)
    got = toxicity.score_texts(odd(spark), model, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs_.limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and toxicity.toxicity(docs_.limit(0), labels).count() == 0


def test_toxicity_learns_from_texts_that_begin_alike(spark, monkeypatch):
    rng, header = random.Random(6), " ".join(f"header{i}" for i in range(12))
    rows = [(i, f"{header} {' '.join(rng.choices([f'word{j}' for j in range(40)], k=15))} n{i}", int(i % 3 == 0)) for i in range(120)]
    rows += [(i, f"{header}  Copied\ttext" if i % 2 else f"{header} copied text", 0) for i in range(1000, 1300)] + [(2000 + i, f"{header} copied text", 1) for i in range(9)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(list(zip(texts, y.tolist()))))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    toxicity.fit(df.select("doc_id", "text"), labels)
    norm = lambda t: " ".join(t.lower().split())
    outside = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert sorted((norm(t), y) for t, y in seen[0]) == sorted({(norm(t), y) for _, t, y in outside})
    toxicity.fit(df.select("doc_id", "text"), labels, sample=50)
    assert len(seen[1]) == len({(norm(t), y) for t, y in seen[1]}) == 50
    monkeypatch.undo()
    texts, y = zip(*[(f"{t} {'vile' if l else 'kind'}", l) for _, t, l in rows[:120]])
    m = toxicity.train(list(texts), np.array(y))
    z = [toxicity.score_text(toxicity.Words(m), t)[0] for t in texts]
    assert min(s for s, l in zip(z, y) if l) > max(s for s, l in zip(z, y) if not l)


def test_toxicity_scores_equal_a_plain_convolution(labelled):
    rows = list(labelled[2].values())[:150]
    model = toxicity.train([r[1] for r in rows], np.array([r[4] for r in rows]), epochs=2)
    words = toxicity.Words(model)
    for text in [r[1] for r in rows[:12]] + ["", None, "idiot", "the of idiot"]:
        vectors = [sum((model.emb[model.rows.get(h, 0)] for h in toxicity.hashed(w)), np.zeros(toxicity.DIM)) for w in (text or "").split()]
        vectors += [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        z = model.out_bias
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = range(len(vectors) - max(toxicity.WIDTHS) + 1)
                top = max(sum(float(vectors[i + j] @ model.filters[k][j, :, f]) for j in range(w)) for i in places)
                z += max(0.0, top + model.bias[k * toxicity.FILTERS + f]) * model.out[k * toxicity.FILTERS + f]
        assert toxicity.score_text(words, text)[0] == pytest.approx(z, abs=1e-4)
        docs_ = [model.encode((text or "").split())]
        assert toxicity.logits(model, docs_)[0] == pytest.approx(z, abs=1e-6)


def test_toxicity_gradients_equal_differences(monkeypatch, labelled):
    rows = list(labelled[2].values())[:60]
    model = toxicity.train([r[1] for r in rows], np.array([r[4] for r in rows]), epochs=0)
    rng = np.random.default_rng(4)
    model.bias, model.out = model.bias + 0.5, rng.normal(size=model.out.shape)
    docs_, y = [model.encode(r[1].split()) for r in rows[:9]], np.array([r[4] for r in rows[:9]], np.float64)
    docs_[3] = docs_[3][:0]

    def loss():
        z = toxicity.logits(model, docs_)
        return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())

    def differ(x, at, eps=1e-6):
        old = x[at]
        x[at] = old + eps
        up = loss()
        x[at] = old - eps
        down = loss()
        x[at] = old
        return (up - down) / (2 * eps)

    whole = toxicity.gradients(model, docs_, y)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 50)
    d_o, d_ob, d_b, d_f, number, d_e = toxicity.gradients(model, docs_, y)
    assert np.allclose(whole[0], d_o) and np.allclose(whole[5], d_e) and (whole[4] == number).all()
    assert all(d_o[i] == pytest.approx(differ(model.out, i), abs=1e-7) for i in range(len(d_o)))
    assert all(d_b[i] == pytest.approx(differ(model.bias, i), abs=1e-7) for i in range(len(d_b)))
    for k in range(len(toxicity.WIDTHS)):
        for at in list(np.ndindex(d_f[k].shape))[::5]:
            assert d_f[k][at] == pytest.approx(differ(model.filters[k], at), abs=1e-7)
    for i, r in enumerate(number[:40]):
        assert all(d_e[i, d] == pytest.approx(differ(model.emb, (r, d)), abs=1e-7) for d in range(0, toxicity.DIM, 3))


def test_toxicity_pools_over_whole_texts(monkeypatch):
    rng = np.random.default_rng(0)
    parts = rng.normal(size=(50, len(toxicity.PARTS) * toxicity.FILTERS)).astype(np.float32)
    parts[0] = 0
    ids = rng.integers(1, 50, 200)
    whole, _ = toxicity.pooled(parts, ids)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.allclose(whole, toxicity.pooled(parts, ids)[0])


def test_toxicity_scores_long_texts_piece_by_piece(monkeypatch):
    rows = corpus(random.Random(10), 300)
    model = toxicity.train([r[1] for r in rows], np.array([r[4] for r in rows]), epochs=1)
    text = " ".join(r[1] for r in rows[:20])
    model.filters[2][0] += 3  # a filter that would fire where a piece is padded
    whole = toxicity.score_text(toxicity.Words(model), text)
    monkeypatch.setattr(toxicity, "CACHE", 40)
    for n in (7, 11, 20):
        monkeypatch.setattr(toxicity, "CHUNK", n)
        pieces = toxicity.score_text(toxicity.Words(model), text)
        assert abs(whole[0] - pieces[0]) < 1e-4 and whole[1] == pieces[1]


def test_quality_shrinks_sparse_sites(spark, labelled):
    docs_, labels, rows = labelled
    out = quality.quality(docs_, labels, F.col("source"), F.col("lang")).collect()
    held = [r for r in out if r.held_out]
    assert sum(r["keep"] == bool(rows[r.doc_id][5]) for r in held) / len(held) > 0.95
    by = {rows[r.doc_id][3]: r.host_posterior for r in out}
    assert by["s7"] < by["s5"] < by["s0"]
    more = quality.quality(docs_.unionByName(odd(spark).select("doc_id", "text", "lang", "source")), labels, F.col("source"), F.col("lang")).collect()
    assert len(more) == len(out) + 6
    assert quality.quality(docs_.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_quality_posteriors_equal_plain_ones(spark, labelled):
    docs_, labels, rows = labelled
    df = docs_.unionByName(spark.createDataFrame([(6000, "a lone text", "xx", "s1"), (6001, "again a lone text", None, "alone"), (6001, "again a lone text", None, "alone"), (None, "t", "en", "s1"), (7000, None, "en", None)], docs_.schema))
    more = labels.unionByName(spark.createDataFrame([(6000, 1, 0), (6000, 0, 0), (None, 1, 1), (6001, None, None)], labels.schema))
    got = quality.quality(df.withColumn("score", F.lit(1)).withColumn("host", F.lit("h")), more, F.col("source"), F.col("lang")).collect()
    label = {r.doc_id: r.quality for r in more.where("quality is not null and doc_id is not null").orderBy("quality").collect()}
    site = {r.doc_id: (r.source, r.lang) for r in df.collect()}
    known = [(*site[r.doc_id], label[r.doc_id] if r.doc_id in label and not r.held_out else round(r.evidence * 1e6) / 1e6) for r in got]
    mean = sum(v for *_, v in known) / len(known)

    def strength(groups, prior):
        big = [(g, v) for g, v in groups.items() if len(v) >= 2]
        spread = mean * (1 - mean)
        between = sum((sum(v) / len(v) - prior(g)) ** 2 for g, v in big) / len(big)
        within = sum(spread / len(v) for _, v in big) / len(big)
        return min(1e4, max(1.0, spread / max(between - within, 1e-4)))

    hosts, paths = {}, {}
    for h, p, v in known:
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, p), []).append(v)
    kh = strength(hosts, lambda h: mean)
    whole = {h: (sum(v) + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(paths, lambda hp: whole[hp[0]])
    for r, (h, p, v) in zip(got, known):
        ph = (sum(hosts[h]) - v + kh * mean) / (len(hosts[h]) - 1 + kh)
        pp = (sum(paths[h, p]) - v + kp * ph) / (len(paths[h, p]) - 1 + kp)
        assert (r.host_posterior, r.path_posterior) == (pytest.approx(ph, abs=1e-5), pytest.approx(pp, abs=1e-5))
    base = got and [r for r in got if r.doc_id == 7000][0]
    assert base.host_posterior == pytest.approx(mean, abs=1e-5)
