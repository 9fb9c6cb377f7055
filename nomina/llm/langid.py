"""Language identification by a bidirectional gated recurrent network over bytes (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm import gru
from nomina.llm.common import octets, sampled, table

#: Most labelled documents that the network is fitted on, those of the smallest hash of the id, and their characters.
TRAIN_DOCS, TRAIN_CHARS = 3000, 1 << 26
HIDDEN, SPAN, BATCH, STEPS, RATE = 8, 64, 128, 260, 0.02
#: Bytes that a lane labels, and those before and after them that only warm up the states.
CORE, WARM, LANES = 224, 16, 2048
#: The code beside a text's ends; it keeps the state at rest.
REST = 256


class Model:
    """langs; forward and backward tables [257, 3H] and recurrent weights [H, 3H]; labelling weights [2H, K] and [K]."""

    def __init__(self, langs: list[str], params: dict):
        self.langs, self.params = langs, params


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    """Fits on random spans; every position is to carry its document's label. None without labelled text."""
    rows = [(np.frombuffer(t, np.uint8), y) for t, y in zip(texts, labels, strict=True) if t and y is not None]
    if not rows:
        return None
    langs = sorted({y for _, y in rows})
    k, n, rng = len(langs), HIDDEN, np.random.default_rng(seed)
    y_all = np.array([langs.index(y) for _, y in rows])
    by = [np.flatnonzero(y_all == i) for i in range(k)]
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"ef": draw(256, 3 * n), "eb": draw(256, 3 * n), "uf": draw(n, 3 * n), "ub": draw(n, 3 * n), "w": draw(2 * n, k), "b": np.zeros(k, np.float32)}
    adam = gru.Adam(p, RATE)
    for step in range(STEPS):
        y = np.concatenate([rng.integers(0, k, BATCH // 2), y_all[rng.integers(0, len(rows), BATCH - BATCH // 2)]])
        codes, mask = np.zeros((SPAN, BATCH), np.int64), np.zeros((SPAN, BATCH), np.float32)
        for j, c in enumerate(y):
            t = rows[by[c][rng.integers(0, len(by[c]))]][0]
            at = rng.integers(0, max(1, len(t) - SPAN + 1))
            piece = t[at : at + SPAN]
            codes[: len(piece), j], mask[: len(piece), j] = piece, 1
        hf, kf = gru.forward(p["ef"][codes], p["uf"], mask)
        hb, kb = gru.forward(p["eb"][codes[::-1]], p["ub"], mask[::-1])
        h = np.concatenate([hf, hb[::-1]], axis=2)
        logits = h @ p["w"] + p["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(BATCH), y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        dh = d @ p["w"].T
        dxf, duf = gru.backward(dh[:, :, :n], kf)
        dxb, dub = gru.backward(dh[::-1, :, n:], kb)
        grads = {"uf": duf, "ub": dub, "w": np.einsum("tbh,tbk->hk", h, d), "b": d.sum(axis=(0, 1))}
        for name, dx, c in (("ef", dxf, codes), ("eb", dxb, codes[::-1])):
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], c.ravel(), dx.reshape(-1, 3 * n))
        adam.step(grads, 1.0 if step < STEPS * 0.6 else 0.3)
    return Model(langs, p)


class Scorer:
    """Pools the labels of all bytes of each text; a text's result depends on the text alone."""

    def __init__(self, model: Model):
        p, n = model.params, HIDDEN
        rest = np.zeros((1, 3 * n), np.float32)
        rest[0, :n] = -60.0
        self.f, self.b = (gru.Lanes(np.concatenate([p["e" + d], rest]).T, p["u" + d]) for d in "fb")
        self.wf, self.wb, self.bias = np.ascontiguousarray(p["w"][:n].T), np.ascontiguousarray(p["w"][n:].T), p["b"][:, None]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities [documents, K] over each text's bytes; zeros for an empty text."""
        sizes = np.diff(offsets)
        lanes = -(-sizes // CORE)
        doc = np.repeat(np.arange(len(sizes)), lanes)
        first = np.cumsum(lanes) - lanes
        start = offsets[doc] + (np.arange(len(doc)) - first[doc]) * CORE
        k = len(self.bias)
        total = np.zeros((len(sizes), k))
        for at in range(0, len(doc), LANES):
            d, s = doc[at : at + LANES], start[at : at + LANES]
            acc = self._lanes(raw, s, offsets[d], offsets[d + 1])
            for j in range(k):
                total[:, j] += np.bincount(d, acc[j], len(sizes))
        return total / np.maximum(sizes, 1)[:, None]

    def _lanes(self, raw: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        steps = CORE + 2 * WARM
        steps = int(min(steps, (high - start).max() + WARM))
        at = start[None, :] - WARM + np.arange(steps)[:, None]
        inside = (at >= low) & (at < high)
        codes = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)].astype(np.intp), REST)
        b = len(start)
        hf = np.empty((steps, HIDDEN, b), np.float32)
        h = self.f.start(b)
        for t in range(steps):
            h = self.f.step(h, codes[t], hf[t])
        h, acc = self.b.start(b), np.zeros((len(self.bias), b), np.float32)
        one, two = np.empty_like(acc), np.empty_like(acc)
        for t in reversed(range(steps)):
            h = self.b.step(h, codes[t], h)
            if WARM <= t < WARM + CORE:
                np.matmul(self.wf, hf[t], out=one)
                np.matmul(self.wb, h, out=two)
                one += two
                one += self.bias
                np.exp(one, out=one)
                one *= inside[t] / one.sum(axis=0)
                acc += one
        return acc


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    """A model from docs' (doc_id, text, lang) where crc32(doc_id) mod 4 isn't 2, lang isn't null and text isn't empty."""
    rows = docs.filter(~_held(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    found = sampled(rows.select("doc_id", "text", F.col("lang").alias("label")), limit, TRAIN_CHARS).collect()
    found.sort(key=lambda r: (r._h, r.doc_id))
    return train([r.text.encode() for r in found], [r.label for r in found])


def _held(doc_id):
    """True where a document is held out; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score, columns of these names replaced.

    lang_pred is `und`, with score 0, where text is null or has no letter or nothing could be learned; else the language
    with the greatest mean probability over all bytes, and that mean."""
    import json

    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*cols).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double"
    letters = docs.select(*cols, F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("_letters"))
    state = None if model is None else (model.langs, {k: v.tolist() for k, v in model.params.items()})
    state = json.dumps(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = json.loads(state)
        langs = got[0] if got else []
        scorer = Scorer(Model(langs, {k: np.array(v, np.float32) for k, v in got[1].items()})) if got else None
        for batch in batches:
            has = np.asarray(batch.column("_letters"))
            raw, offsets, _ = octets(batch.column("text"))
            if scorer is None or not len(raw):
                pred, score = ["und"] * len(has), np.zeros(len(has))
            else:
                p = scorer(raw, offsets)
                best = p.argmax(axis=1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score = np.where(has, np.round(np.minimum(p.max(axis=1), 1.0), 4), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*cols, "lang_pred", "score"])

    return letters.mapInArrow(run, out)


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
