"""Brute force for fingerprints, networks and long words."""

import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nomina.llm import fingerprints, gru, langid, packing, tokencount, toxicity
from nomina.llm.common import sampled

rng = np.random.default_rng(6)


def spark_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def shingles(text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_against_brute_force(spark, tmp_path):
    base = " ".join(rng.choice([f"w{i}" for i in range(3000)], 900))
    texts = [base, base + " end", base[: len(base) // 2], "", None, "one two", "日本 \U0001d15e café x y z", "a b c d e", " \t\n", base]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.op4_bottom_k_fingerprints(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in texts]
    k = fingerprints.K
    sketch = lambda t: sorted(spark_hash(s) for s in shingles(t))[:k]
    text_of = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)

    def union(a, b):
        return sorted({*a, *b})[:k]

    def near(a, b):
        u = union(a, b)
        return len({*a} & {*b} & {*u}) / len(u) if u else 1.0

    def distinct(a):
        return float(len(a)) if len(a) < k else (k - 1) / ((a[-1] + 2.0**63) / 2.0**64)

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        r = got[3 * i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t == "a b c d e" or len(t.split()) >= 5 or not t.strip():  # a short text's hash is that of an array
            assert r.fingerprint == text_of(a)
        if all(len(x.split()) >= 5 or not x.strip() for x in (t, edited, after)):
            u = union(a, b)
            assert np.isclose([r.near_edited, r.near_next, r.n_distinct, r.n_distinct_with_next], [near(a, b), near(a, c), distinct(a), distinct(union(a, c))]).all()
            assert np.isclose(r.kept_by_edit, len({*a} & {*b} & {*u}) / len({*a} & {*u}) if a else 1.0)
    assert abs(got[0].n_distinct - len(shingles(base))) < 0.3 * len(shingles(base)) and got[0].fingerprint == got[27].fingerprint


def test_merged_sketches_are_those_of_the_whole(spark):
    parts = [" ".join(rng.choice([f"w{i}" for i in range(500)], 200)) for _ in range(2)]
    df = spark.createDataFrame([tuple(parts)], "a string, b string")
    s = df.select(fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("s")).first().s
    assert s == sorted(spark_hash(x) for x in shingles(parts[0]) | shingles(parts[1]))[: fingerprints.K]


def test_language_scorer_is_the_plain_network():
    """Texts shorter than a lane and its warm-up: states and labels of the plain forward pass, position by position."""
    texts = [b"the house", "l'été est là".encode(), b"x", bytes(rng.integers(97, 123, 200).tolist())]
    model = langid.train(texts * 3, ["en", "fr", "en", "de"] * 3)
    raw, sizes = np.frombuffer(b"".join(texts), np.uint8), [len(t) for t in texts]
    got = langid.Scorer(model)(raw, np.concatenate([[0], np.cumsum(sizes)]))
    p = model.params
    for t, mine in zip(texts, got, strict=True):
        codes = np.frombuffer(t, np.uint8).astype(np.int64)[:, None]
        mask = np.ones(codes.shape, np.float32)
        hf, _ = gru.forward(p["ef"][codes], p["uf"], mask)
        hb, _ = gru.forward(p["eb"][codes[::-1]], p["ub"], mask)
        logits = np.concatenate([hf, hb[::-1]], axis=2) @ p["w"] + p["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        assert np.allclose((e / e.sum(axis=2, keepdims=True)).mean(axis=(0, 1)), mine, atol=1e-4)


def test_toxicity_scorer_is_the_plain_network():
    """Greatest logit of the plain forward pass over all windows of whole texts."""
    words = [f"w{i}".encode() for i in range(40)] + [b"idiot"]
    rows = [(b" ".join(words[j] for j in rng.integers(0, 40, 90)) + (b" idiot" if i % 2 else b""), i % 2) for i in range(40)]
    model = toxicity.train(rows)
    docs = [toxicity.words(t) for t, _ in rows[:6]] + [[b"idiot"], words * 4]
    got = toxicity.Scorer(model).logits(docs)
    for d, mine in zip(docs, got, strict=True):
        starts = range(0, max(1, len(d) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        windows = [d[a : a + toxicity.WINDOW] for a in starts]
        pieces = sorted({w for win in windows for w in win})
        ids, mask = np.zeros((toxicity.WINDOW, len(windows)), np.int64), np.zeros((toxicity.WINDOW, len(windows)), np.float32)
        for j, win in enumerate(windows):
            ids[: len(win), j], mask[: len(win), j] = [pieces.index(w) for w in win], 1
        logits, _ = toxicity._forward(model.params, model.vocab, pieces, ids, mask)
        assert abs(logits.max() - mine) < 1e-3


def test_sampled_rows_are_bounded(spark):
    rows = [(i, "x" * (1000 if i == 3 else 10), "b") for i in range(100)] + [(5, "a", "a")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sampled(df, 100, 1 << 20).collect()
    assert len(got) == 100 and [(r.label, r.text) for r in got if r.doc_id == 5] == [("a", "a")]
    assert len(sampled(df, 10, 1 << 20).collect()) == 10 and sum(len(r.text) for r in sampled(df, 100, 60).collect()) < 1070


def test_long_words():
    vocabulary = tokencount.zipf_vocabulary(packing.vocabulary_path(tokencount.VOCABULARY))
    counter = tokencount.Counter(vocabulary)
    words = ["日x" * 40, "abc☃☃def" * 9, "z", "the" * 50, "☃" * 30, "<unk>a<unk><unk>"]
    assert [counter._count_long(w) for w in words] == counter._count(sorted(words, key=len)).tolist() or [counter._count_long(w) for w in words] == [int(counter._count([w])[0]) for w in words]
    long = "".join(rng.choice(list("abcdefgh日"), 100_000))
    assert counter([long, "the"])[0] > 10_000
