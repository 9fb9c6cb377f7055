import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nomina.llm import fingerprints, langid, mixing, neardup, packing, passages, sharding, tokencount, topk, toxicity
from nomina.llm.common import octets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(200), prose(70)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", "en", "b", 1), (4, None, None, None, None), (5, "", "fr", "b", 0), (None, prose(30), "fr", "b", 1)]
    rows += [(10, prose(80) + " " + passage, "en", "c", 1), (11, passage + " " + prose(90), "fr", "c", 1), (12, prose(9000), "fr", "c", 1), (13, "a b", "en", "a", 3), (13, "a b", "en", "a", 3), (14, "\u65e5\u672c  \n", "en", None, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, empty):
    got = mixing.mix(docs.withColumn("size", F.lit("mine"))).toPandas()
    assert len(got) == 12 and (got.taken <= 3 * got["size"]).all() and abs(got.drop_duplicates("target").target.sum() - got["size"].sum()) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_shards(docs, empty):
    got = sharding.place(docs).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 16)).all()
    assert sharding.place(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    d = docs.filter("doc_id < 20").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(d, ["text"]).toPandas().sort_values(["doc_id", "text"]).reset_index(drop=True)
    assert list(got.next_text) == list(got.text[1:]) + [got.text[0]]
    s = d.select("doc_id", fingerprints.sketch(F.col("text"), 16).alias("s")).toPandas().set_index("doc_id").s
    assert list(s[1]) == list(s[2]) and len(s[4]) == 0 and len(s[12]) == 16 and list(s[12]) == sorted(s[12])
    assert fingerprints.with_next(empty.select("doc_id", "text"), ["text"]).count() == 0


def test_near_duplicates(docs, empty):
    got = neardup.groups(docs).toPandas()
    by = got.dropna().drop_duplicates("doc_id").set_index("doc_id")
    assert by.component_id[2] == by.component_id[3] == 1 and by.component_id[13] == 13 and by.component_id[4] == 4
    assert by.n_shingles[4] == by.n_shingles[5] == 0 and by.n_shingles[13] == 1 and len(got) == 12
    assert neardup.groups(empty).count() == 0
    assert neardup.least_slots(128, 85) == 83 and neardup.least_slots(1024, 85) == 798


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    texts = []
    for _ in range(8):
        base = rng.choice(WORDS, 160).tolist()
        for edits in range(7):
            own = list(base)
            for at in rng.choice(160, edits, replace=False):
                own[at] = "X" + own[at]
            texts.append(" ".join(own))
    sets = [{tuple(t.lower().split()[i : i + width]) for i in range(160 - width + 1)} for t in texts]
    root = list(range(len(sets)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(df, width, percent).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_rows_of_one_id_are_one_document(spark):
    a, b = "a " + prose(60), "b " + prose(60)
    rows = [(1, b, "x"), (1, a, "y"), (1, b, "z"), (2, a, "x"), (3, b, "x"), (4, b, "x"), (4, None, "x"), (5, None, "x"), (5, None, "x"), (None, a, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = [(1, 57, 1, True)] * 3 + [(2, 57, 1, False), (3, 57, 3, True)] + [(4, 0, 4, True)] * 2 + [(5, 0, 5, True)] * 2 + [(None, 57, None, True)] * 2
    for parts in (1, 5):
        got = [tuple(r) for r in neardup.groups(df.repartition(parts)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_superminhash_estimates():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    s = neardup.signatures(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 512)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.06


def test_packing(docs, empty):
    got = packing.place(packing.pieces(docs, packing.vocabulary_path())).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 4096 and (got.length > 0).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()
    one = got[got.doc_id == 5].iloc[0]
    assert (one.length, one.ids_crc32) == (1, zlib.crc32(b"\1\0\0\0"))
    assert packing.place(packing.pieces(empty, packing.vocabulary_path())).count() == 0


@pytest.mark.parametrize("limit, size", [(3, 200), (1000, 1 << 24)])
def test_ids_are_those_of_whole_texts(spark, monkeypatch, limit, size):
    monkeypatch.setattr(packing, "SLICE", size)
    letters = "a\u00e9\u0301\u0958,.'s1\u00b2!\" <| \u3000\x1c\u00df\u0130\u03a3\U0001d15e\u65e5\xa0\xd7\xf7\u2026\xc9B"
    texts = ["don't \"foo\", bar! \u0958. ab <|endoftext|>, x<|ENDOFTEXT|> y 12,5%", "Stra\u00dfe, caf\u00e9; the the, the.", "", " "]
    texts += ["".join(rng.choice(list(letters), 30)) for _ in range(400)]
    ids = packing.TokenIds(packing.vocabulary_path(), limit)
    lower = [t if "<|" in t else "".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    for at in (0, 7):
        raw, offsets, _ = octets(pa.array(lower[at:]))
        flat, first = ids(raw, offsets)
        for i, t in enumerate(texts[at:]):
            assert flat[first[i] : first[i + 1]].tolist() == ids.tok.encode(t, add_special_tokens=False).ids, t


def _contents(patterns, capacity):
    held = np.zeros(capacity + 1, int)
    for times, content in patterns:
        assert sum(s * m for s, m in content) <= capacity and times > 0
        for s, m in content:
            held[s] += times * m
    return held


def test_bin_completion_reaches_the_bound():
    counts = np.zeros(101, int)
    counts[[26, 24, 51, 49, 60, 20]] += [3, 3, 2, 2, 2, 4]
    p = packing.pack(counts, 100)
    assert sum(t for t, _ in p) == packing.lower_bound(counts, 100) and (_contents(p, 100) == counts).all()


def _least_sequences(sizes, capacity):
    """By trying every place of every piece."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_whole_search_against_brute_force():
    draw, better = np.random.default_rng(5), 0
    for _ in range(400):
        capacity = int(draw.integers(10, 60))
        sizes = draw.integers(1 + capacity // 8, 2 + capacity // 2, int(draw.integers(0, 12))).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
        p = packing.pack(counts, capacity, None, None, None)
        assert (_contents(p, capacity) == counts).all() and sum(t for t, _ in p) == _least_sequences(sizes, capacity)
        some = packing.pack(counts, capacity, 1, 1, 1)
        assert (_contents(some, capacity) == counts).all()
        better += sum(t for t, _ in p) < sum(t for t, _ in packing.best_fit(counts, capacity))
    assert better


def test_repeated_rows_are_packed_as_often_as_they_stand_there(spark):
    rows = spark.createDataFrame([(1, "a b c")] * 500 + [(None, None)] * 500, "doc_id long, text string").repartition(3)
    got = packing.place(packing.pieces(rows, packing.vocabulary_path(), 16), 16).toPandas()
    assert len(got) == 1000 and got.sequence_id.nunique() == 500 * 4 // 16 + 500 // 16 + 1
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()


def test_passages(docs, empty):
    got = passages.repeated(docs).toPandas()
    assert {2, 3, 11} == set(got.doc_id) and got[got.doc_id == 11].iloc[0].source_id == 10 and abs(got[got.doc_id == 11].iloc[0].words - 70) < 3
    rest = passages.without_repeats(docs, passages.repeated(docs)).toPandas()
    assert len(rest) == 12 and len(rest[rest.doc_id == 11].text.iloc[0].split()) < 95
    assert passages.repeated(empty).count() == 0


@pytest.mark.parametrize("parts", [3, 100])
def test_passages_behind_a_part_of_them(spark, parts):
    """An earlier document holds a part of a passage that later ones repeat whole; held against all runs of 50 words."""
    own, texts = np.random.default_rng(8), []
    few = lambda n: own.choice([f"v{i}" for i in range(5000)], n).tolist()
    for _ in range(25):
        passage = few(52)
        texts += [few(60) + passage[2:50] + few(60)] + [few(60) + passage + few(60) for _ in range(3)]
    seen, want = {}, set()
    for i, t in enumerate(texts):
        for a in range(len(t) - 49):
            if seen.setdefault(tuple(t[a : a + 50]), i) < i:
                want |= {(i, w) for w in range(a, a + 50)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts, "doc_id")
    got = set()
    for r in passages.repeated(df).collect():
        at = len(" ".join(texts[r.doc_id])[: r.start].split())
        got |= {(r.doc_id, w) for w in range(at, at + r.words)}
    assert len({i for i, _ in want}) == 50 and want <= got


def test_compact_windows_against_brute_force():
    h = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    l, c, r = passages.compact_windows(h, np.zeros(200, int), np.array([0]), np.array([199]), 10)
    got = {(a, b, d) for a, b, d in zip(l.tolist(), c.tolist(), r.tolist(), strict=True)}
    want = set()
    for i in range(200):
        a, b = i, i
        while a > 0 and h[a - 1] > h[i]:
            a -= 1
        while b < 199 and h[b + 1] > h[i]:
            b += 1
        if b - a + 1 >= 10:
            want.add((a, i, b))
    assert got == want


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.zipf_vocabulary(packing.vocabulary_path(tokencount.VOCABULARY))
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always")])
    texts = ["Übergröße \u2603\u2603a\u2603 x", "aaaa bbbb", "\x1cab \u3000cd", "x" * 300]
    counter = tokencount.Counter(vocabulary)
    assert [int(counter(tokencount.split(t)).sum()) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokencount.count(docs, packing.vocabulary_path(tokencount.VOCABULARY)).filter("doc_id in (4, 5) and n_tokens = 0").count() == 2
    assert tokencount.count(empty, packing.vocabulary_path(tokencount.VOCABULARY)).count() == 0


def test_top_k(spark):
    v = rng.standard_normal((120, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [float("nan")] * 8), (None, [1.0] * 8), (202, [None] * 8), (250, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).toPandas()
    x, ids = np.vstack([np.floor(256 * v.astype(float)), np.zeros((1, 8))]), np.array([*range(120), 250])
    for q in (0, 50, 100, 250):
        s = x @ x[ids == q][0]
        s[ids == q] = -1e18
        order = np.lexsort((ids, -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(ids[order]) and list(mine.score) == [int(a) for a in s[order]]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    v = rng.standard_normal((40, 8)).astype(np.float32)
    ids = np.array([*range(40), *range(1, 40), *[7] * 5, 0])
    df = spark.createDataFrame([(int(i), [float(x) for x in v[i]]) for i in ids], "vec_id long, embedding array<float>")
    x = np.floor(256 * v.astype(float))
    for rows, times in ((df, 2), (df.filter("vec_id > 0").union(df.filter("vec_id = 0").limit(1)), 1)):
        mine = topk.top_k(rows, F.col("vec_id") == 0).orderBy("rank").collect()
        others = np.repeat(ids[ids != 0], times)
        score = x[others] @ x[0]
        order = np.lexsort((others, -score))[:5]
        assert [(r["rank"], r.vec_id, r.score) for r in mine] == [(n + 1, others[o], int(score[o])) for n, o in enumerate(order)]


def test_top_k_of_repeated_rows_over_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 8)
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(40, [40.0, 1.0])] * 5 + [(0, [1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [40] * 5 + [39, 38]


def test_classifiers(spark, docs, empty):
    words = {"en": ["the", "house", "walk"], "fr": ["le", "été", "maison"]}
    rows = [(i, " ".join(rng.choice(words[y], 40)), y, "s", 1) for i, y in enumerate(["en", "fr"] * 60)]
    train = spark.createDataFrame(rows, DOCS)
    model = langid.fit(train)
    got = langid.identify(train, model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert set(langid.identify(docs, model).filter("doc_id in (4, 5)").toPandas().lang_pred) == {"und"}
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    bad = spark.createDataFrame([(i, prose(60) + (" idiot scum " if i % 2 else " ") + prose(60), None, None, 1) for i in range(120)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    scored = toxicity.score(bad, toxicity.fit(bad, labels)).toPandas()
    assert scored.score.between(0, 1).all() and ((scored.predicted == 1) == (scored.doc_id % 2 == 1)).mean() > 0.7
    assert toxicity.score(docs, None).toPandas().score.eq(0).all()


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(60 + i), ["en", "fr"][i % 2], f"s{i % 3}", 1, "x") for i in range(40)]
    spark.createDataFrame(rows, DOCS + ", size string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 4096
