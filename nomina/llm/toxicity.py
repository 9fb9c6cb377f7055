"""Toxicity by a bidirectional gated recurrent network with attention pooling over characters and words (operator 1)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm import gru
from nomina.llm.common import sampled, table, texts

#: Most labelled documents of each label that the network is fitted on, those of the smallest hash of the id, and their
#: characters.
TRAIN_DOCS, TRAIN_CHARS = 2000, 1 << 26
#: Words in a window and from one window's start to the next: every word but the outermost lies in two windows.
WINDOW, STRIDE = 48, 24
#: Letters of a word; longer runs of letters are several words.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]{1,24}")
CHARS, HIDDEN, EMBED, ATTEND = 8, 8, 8, 8
#: Words have an embedding of their own if so many of the fitted documents hold them; the others share the first.
COMMON = 6
#: Documents of each label in a step, windows drawn of each, steps, rate, weight decay.
BAGS, DRAWS, STEPS, RATE, DECAY = 16, 4, 320, 0.02, 0.1
LANES, REMEMBER = 1024, 300_000


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _codes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [T, N] of each word and which are there."""
    sizes = np.array([len(p) for p in pieces])
    at = np.arange(int(sizes.max(initial=1)))[None, :]
    mask = at < sizes[:, None]
    codes = np.zeros(mask.shape, np.intp)
    codes[mask] = np.frombuffer(b"".join(pieces), np.uint8)
    return np.ascontiguousarray(codes.T), np.ascontiguousarray(mask.T).astype(np.float32)


def _start(rng: np.random.Generator, known: int) -> dict:
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    c, h, d = CHARS, HIDDEN, 2 * CHARS + EMBED
    p = {"emb": np.zeros((known + 1, EMBED), np.float32), "att": draw(2 * h, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": draw(ATTEND), "out": draw(2 * h), "out_b": np.full(1, -1.0, np.float32)}
    for way in "fb":
        p |= {f"ce_{way}": draw(256, 3 * c), f"cu_{way}": draw(c, 3 * c), f"in_{way}": draw(d, 3 * h), f"in_b_{way}": np.zeros(3 * h, np.float32), f"u_{way}": draw(h, 3 * h)}
    return p


def _forward(p: dict, vocab: dict, pieces: list[bytes], ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits [B] of windows ids [T, B] into pieces, and what _backward() needs."""
    codes, there = _codes(pieces)
    k: dict = {"codes": codes, "word": np.array([vocab.get(w, 0) for w in pieces], np.int64), "ids": ids}
    ends = []
    for way, c, m in (("f", codes, there), ("b", codes[::-1], there[::-1])):
        hs, k["c" + way] = gru.forward(p["ce_" + way][c], p["cu_" + way], m)
        ends.append(hs[-1])
    k["feats"] = np.concatenate([*ends, p["emb"][k["word"]]], axis=1)
    hs = []
    for way, flip in (("f", slice(None)), ("b", slice(None, None, -1))):
        x = (k["feats"] @ p["in_" + way] + p["in_b_" + way])[ids[flip]]
        h, k["w" + way] = gru.forward(x, p["u_" + way], mask[flip])
        hs.append(h[flip])
    h = np.concatenate(hs, axis=2)
    e = np.tanh(h @ p["att"] + p["att_b"])
    a = np.where(mask > 0, e @ p["att_v"], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    s = np.einsum("tb,tbh->bh", a, h)
    return s @ p["out"] + p["out_b"], k | {"h": h, "e": e, "a": a, "s": s}


def _backward(p: dict, k: dict, d: np.ndarray) -> dict:
    """Gradients from those of the logits."""
    h, e, a, n = k["h"], k["e"], k["a"], HIDDEN
    g = {"out": k["s"].T @ d, "out_b": d.sum(keepdims=True)}
    ds = d[:, None] * p["out"]
    da = np.einsum("tbh,bh->tb", h, ds)
    da = a * (da - (a * da).sum(axis=0))
    g["att_v"] = np.einsum("tb,tbd->d", da, e)
    de = da[:, :, None] * p["att_v"] * (1 - e * e)
    g["att"], g["att_b"] = np.einsum("tbh,tbd->hd", h, de), de.sum(axis=(0, 1))
    dh = a[:, :, None] * ds + de @ p["att"].T
    dfeats = np.zeros_like(k["feats"])
    for way, flip, part in (("f", slice(None), dh[:, :, :n]), ("b", slice(None, None, -1), dh[::-1, :, n:])):
        dx, g["u_" + way] = gru.backward(part, k["w" + way])
        dp = np.zeros((len(k["feats"]), 3 * n), np.float32)
        np.add.at(dp, k["ids"][flip].ravel(), dx.reshape(-1, 3 * n))
        g["in_" + way], g["in_b_" + way] = k["feats"].T @ dp, dp.sum(axis=0)
        dfeats += dp @ p["in_" + way].T
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], k["word"], dfeats[:, 2 * CHARS :])
    for way, c, part in (("f", k["codes"], dfeats[:, :CHARS]), ("b", k["codes"][::-1], dfeats[:, CHARS : 2 * CHARS])):
        dhs = np.zeros((*c.shape, CHARS), np.float32)
        dhs[-1] = part
        dx, g["cu_" + way] = gru.backward(dhs, k["c" + way])
        g["ce_" + way] = np.zeros_like(p["ce_" + way])
        np.add.at(g["ce_" + way], c.ravel(), dx.reshape(-1, 3 * CHARS))
    return g


class Model:
    """params, the embeddings' places by word, and slope and shift of the logistic curve from a document's greatest window logit to its score."""

    def __init__(self, params: dict, vocab: dict[bytes, int], curve: tuple[float, float]):
        self.params, self.vocab, self.curve = params, vocab, curve


def train(rows: list[tuple[bytes, int]], seed: int = 11) -> Model | None:
    """Fits on windows of labelled documents; a document's label holds for its most toxic window, so of the windows drawn
    of a document only that is learned from. None without both labels."""
    own = [(words(t), y) for t, y in rows]
    own = [(w, y) for w, y in own if w]
    rng = np.random.default_rng(seed)
    held = rng.random(len(own)) < 0.2 if len(own) > 200 else np.zeros(len(own), bool)
    by = [[w for (w, y), h in zip(own, held, strict=True) if y == label and not h] for label in (0, 1)]
    if not by[0] or not by[1]:
        return None
    many = Counter(w for words_ in by for d in words_ for w in set(d))
    vocab = {w: i + 1 for i, w in enumerate(sorted(w for w, n in many.items() if n >= COMMON))}
    p = _start(rng, len(vocab))
    adam = gru.Adam(p, RATE, decay=DECAY)
    y = np.repeat([0.0, 1.0], BAGS).astype(np.float32)
    for step in range(STEPS):
        windows = []
        for label in (0, 1):
            for _ in range(BAGS):
                w = by[label][rng.integers(0, len(by[label]))]
                windows += [w[a : a + WINDOW] for a in rng.integers(0, max(1, len(w) - WINDOW + 1), DRAWS)]
        pieces = sorted({w for win in windows for w in win})
        place = {w: i for i, w in enumerate(pieces)}
        ids, mask = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.float32)
        for j, win in enumerate(windows):
            ids[: len(win), j], mask[: len(win), j] = [place[w] for w in win], 1
        logits, k = _forward(p, vocab, pieces, ids, mask)
        top = logits.reshape(-1, DRAWS).argmax(axis=1)
        d = np.zeros((2 * BAGS, DRAWS), np.float32)
        at = np.arange(2 * BAGS)
        d[at, top] = gru.sigmoid(logits.reshape(-1, DRAWS)[at, top]) - y
        adam.step(_backward(p, k, d.reshape(-1) / (2 * BAGS)), 1.0 if step < STEPS * 0.7 else 0.3)
    model = Model(p, vocab, (1.0, 0.0))
    test = [i for i in range(len(own)) if held[i]] or list(range(len(own)))
    x = Scorer(model).logits([own[i][0] for i in test])
    model.curve = _curve(x, np.array([own[i][1] for i in test], float))
    return model


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Logistic regression of y on x, by gradient steps on the scaled x."""
    if y.min() == y.max():
        return 1.0, 0.0
    mean, sd = x.mean(), x.std() + 1e-6
    z, a, b = (x - mean) / sd, 1.0, 0.0
    for _ in range(steps):
        d = gru.sigmoid(a * z + b) - y
        a, b = a - 0.5 * ((d * z).mean() + 0.01 * a), b - 0.5 * d.mean()
    a = max(a, 1e-3)
    return float(a / sd), float(b - a * mean / sd)


class Scorer:
    """Window logits of whole texts. A word's characters and embedding are run once and remembered."""

    def __init__(self, model: Model):
        self.p, self.vocab, self.curve = model.params, model.vocab, model.curve
        self.char = [gru.Lanes(np.concatenate([self.p["ce_" + w], self._rest(CHARS)]).T, self.p["cu_" + w]) for w in "fb"]
        self.way = [gru.Lanes(np.zeros((3 * HIDDEN, 1)), self.p["u_" + w]) for w in "fb"]
        self.half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)
        self._clear()

    @staticmethod
    def _rest(n: int) -> np.ndarray:
        row = np.zeros((1, 3 * n), np.float32)
        row[0, :n] = -60.0
        return row

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.rows, self.used = np.empty((1024, 6 * HIDDEN), np.float32), 1
        self.rows[0] = np.tile(self._rest(HIDDEN)[0] * self.half, 2)

    def _learn(self, new: list[bytes]) -> None:
        new.sort(key=len)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            codes, there = _codes(part)
            codes[there == 0] = 256
            ends = []
            for lanes, c in zip(self.char, (codes, codes[::-1]), strict=True):
                h = lanes.start(len(part))
                for row in c:
                    h = lanes.step(h, row, h)
                ends.append(h.T)
            feats = np.concatenate([*ends, self.p["emb"][[self.vocab.get(w, 0) for w in part]]], axis=1)
            x = np.concatenate([(feats @ self.p["in_" + w] + self.p["in_b_" + w]) * self.half for w in "fb"], axis=1)
            need = self.used + len(part)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty((max(need, len(self.rows)), 6 * HIDDEN), np.float32)])
            self.rows[self.used : need] = x
            self.seen.update(zip(part, range(self.used, need), strict=True))
            self.used = need

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        """Each document's greatest logit over all its overlapping windows; one without words is a window at rest."""
        if len(self.seen) > REMEMBER:
            self._clear()
        self._learn(list({w for d in docs for w in d}.difference(self.seen)))
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.fromiter((self.seen[w] for d in docs for w in d), np.int64, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes
        windows = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(docs)), windows)
        low = (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
        out = np.full(len(docs), -np.inf)
        for at in range(0, len(doc), LANES):
            d, s = doc[at : at + LANES], low[at : at + LANES]
            place = s[None, :] + np.arange(WINDOW)[:, None]
            inside = place < sizes[d]
            ids = np.where(inside, flat[np.minimum(base[d] + place, len(flat) - 1)], 0) if len(flat) else np.zeros(place.shape, np.int64)
            np.maximum.at(out, d, self._windows(ids, inside))
        return out

    def _windows(self, ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
        steps, b, n = *ids.shape, HIDDEN
        h = np.empty((steps, 2 * n, b), np.float32)
        for i, (lanes, order) in enumerate(zip(self.way, (range(steps), reversed(range(steps))), strict=True)):
            now, part = lanes.start(b), slice(3 * n * i, 3 * n * (i + 1))
            for t in order:
                lanes.x[:] = self.rows[ids[t], part].T
                now = _step(lanes, now, h[t, n * i : n * (i + 1)])
        p = self.p
        e = np.tanh(np.matmul(p["att"].T, h) + p["att_b"][:, None])
        a = np.matmul(p["att_v"], e)
        a[~inside] = -1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        s = (h * a[:, None, :]).sum(axis=0)
        return p["out"] @ s + p["out_b"]

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        a, b = self.curve
        return gru.sigmoid(a * self.logits(docs).astype(np.float64) + b)


def _step(lanes: gru.Lanes, h: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A step whose inputs lie in lanes.x already."""
    n, x, g = lanes.n, lanes.x, lanes.g
    np.matmul(lanes.u, h, out=g)
    zr, c, gc = x[: 2 * n], x[2 * n :], g[2 * n :]
    zr += g[: 2 * n]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    gc *= zr[n:]
    c += gc
    np.tanh(c, out=c)
    c -= h
    c *= zr[:n]
    np.add(h, c, out=out)
    return out


def _held(doc_id):
    """True where a document is held out; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    """A model from at most `limit` documents of each label of labels (doc_id, toxic), held-out ones left out.

    A document whose rows in labels disagree counts as toxic."""
    known = labels.filter(~_held(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = []
    for y in (0, 1):
        own = docs.filter("text IS NOT NULL").select("doc_id", "text", F.lit(y).alias("label"))
        found = sampled(own, limit, TRAIN_CHARS, known.filter(F.col("toxic") == y))
        rows += [(r.text.encode(), y) for r in sorted(found.collect(), key=lambda r: (r._h, r.doc_id))]
    return train(rows)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score and predicted (1 from a score of 0.5), columns of these names replaced.

    A null, empty or wordless text is scored as a window at rest; where nothing could be learned all scores are 0."""
    cols = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*cols).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double, predicted int"
    state = None if model is None else json.dumps([{k: v.tolist() for k, v in model.params.items()}, {w.decode("latin1"): i for w, i in model.vocab.items()}, model.curve])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if state:
            params, vocab, curve = json.loads(state)
            vocab = {w.encode("latin1"): i for w, i in vocab.items()}
            scorer = Scorer(Model({k: np.array(v, np.float32) for k, v in params.items()}, vocab, tuple(curve)))
        for batch in batches:
            got = np.zeros(len(batch))
            if scorer is not None:
                raw = texts(batch.column("text"))
                for at in range(0, len(raw), 1000):
                    got[at : at + 1000] = np.round(scorer.scores([words(t) for t in raw[at : at + 1000]]), 5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*cols, "score", "predicted"])

    return docs.select(*cols).mapInArrow(run, out)


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "score", "predicted")
