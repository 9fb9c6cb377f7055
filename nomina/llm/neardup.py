"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm.common import WordHashes, mix64, shingles, stored, table, texts
from nomina.llm.components import components

#: Slots of a signature; a band is ROWS of them. A pair shares no band with probability 6e-11 at a likeness of 0.85, 5e-8 at 0.8.
SLOTS, ROWS = 128, 4
#: Slots of the longer signature that members of one bucket in different components are compared by.
FINE = 1024
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
#: Words in a shingle; links need 100 * common >= PERCENT * union. The query op8 fixes its own.
WIDTH, PERCENT = 5, 80
OP8_WIDTH, OP8_PERCENT = 3, 85
#: Shingles whose permutations are held at once.
CHUNK = 150_000


def least_slots(slots: int, percent: int) -> int:
    """Pairs that agree in fewer slots aren't linked: over 6 standard deviations below the likeness."""
    p = percent / 100
    return math.ceil(slots * p - 6.4 * math.sqrt(slots * p * (1 - p)))


def signatures(hashes: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of documents: [docs, slots] float64; `doc` is the document of each distinct hash, ascending.

    In step j an element offers j plus a fraction to the j-th slot of its own random permutation. Whatever comes later
    is at least j + 1, so a document stops once all its slots are below that."""
    sig = np.full((docs, slots), np.inf)
    flat, perm, active = sig.reshape(-1), None, np.arange(len(hashes))
    h, d = hashes, doc.astype(np.int64)
    for j in range(slots):
        r = mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (r >> np.uint64(24)).astype(np.float64) * 2.0**-40 + j
        k = j + (((r & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        slot = k if perm is None else perm[np.arange(len(k)), k].astype(np.int64)
        np.minimum.at(flat, d * slots + slot, value)
        go = (sig.max(axis=1) >= j + 1)[d]
        if not go.any():
            break
        if perm is None:
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(go.sum()), slots)).copy()
        else:
            perm = perm[go]
        h, d, k, slot, active = h[go], d[go], k[go], slot[go], active[go]
        at = np.arange(len(k))
        perm[at, k] = perm[at, j]
        perm[at, j] = slot
    return sig


def shingle_sets(column: pa.Array, words: WordHashes, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words between ASCII white space."""
    return [np.unique(shingles(words(t.lower().split()), width)) for t in texts(column)]


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    bands = SLOTS // ROWS
    for batch in batches:
        sets = shingle_sets(batch.column(1), words, width)
        n = np.array([len(s) for s in sets], np.int64)
        keys, short, low = [np.zeros((0, bands), np.uint64)], [], []
        at = 0
        while at < len(sets):
            to = at + 1
            total = n[at]
            while to < len(sets) and total + n[to] <= CHUNK:
                total += n[to]
                to += 1
            sig = signatures(np.concatenate(sets[at:to]), np.repeat(np.arange(to - at), n[at:to]), to - at)
            bits = np.where(np.isinf(sig), -1.0, sig).view(np.uint64).reshape(to - at, bands, ROWS)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (to - at, bands)).copy()
            for i in range(ROWS):
                key = mix64(key ^ bits[:, :, i])
            keys.append(key)
            low += [x.tobytes() for x in key.astype(np.uint32)]
            short += [x.tobytes() for x in (mix64(bits.reshape(to - at, SLOTS)) & np.uint64(255)).astype(np.uint8)]
            at = to
        keys = np.concatenate(keys).view(np.int64)
        # of the whole set: sums of two mixes; sets are taken as equal where size and both agree
        one = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        two = np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), lists, pa.array(short, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n", "s1", "s2", "bands", "sig", "low"])


def _fine(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        short = []
        for s in shingle_sets(batch.column(1), words, width):
            sig = signatures(s, np.zeros(len(s), np.int64), 1, FINE)
            short.append((mix64(sig.view(np.uint64)[0]) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["doc_id", "fine"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b) those whose full shingle sets are near enough."""
    words, kept = WordHashes(), {}

    def of(key: int, text: bytes) -> np.ndarray:
        if key not in kept:
            if len(kept) > 256:
                kept.clear()
            kept[key] = np.unique(shingles(words(text.lower().split()), width))
        return kept[key]

    for batch in batches:
        ids, ok = [batch.column(i).to_pylist() for i in (0, 1)], []
        ta, tb = (batch.column(i) for i in (2, 3))
        for i, (a, b) in enumerate(zip(*ids, strict=True)):
            x, y = of(a, ta[i].as_py().encode()), of(b, tb[i].as_py().encode())
            common = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _confirmed(pairs: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full texts are linked; own has (doc_id, text) of all of them, once."""
    one = own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return stored(full.mapInArrow(lambda rows: _verify(rows, width, percent), "a long, b long"))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text), with shingles of `width` words
    and links where 100 * common >= percent * union.

    Equal shingle sets form classes first, so that copies cost one row each and only class representatives (the smallest
    id) are compared. In a bucket of a band all are checked against the bucket's smallest id; members that are then
    still in different components of one bucket are checked against each other, so no link between classes is lost.
    A null or wordless text has no shingles and stands alone; a row with a null id stands alone with null component_id
    and kept true; rows with the same id are one document, that of the least of their texts (a null one is empty), and
    each gives that document's row. No rows: no rows."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    again = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"))
    if again.isEmpty():
        return _groups(docs, width, percent)
    many = docs.join(again, "doc_id", "left_semi")
    found = _groups(docs.join(again, "doc_id", "left_anti").union(stored(many.groupBy("doc_id").agg(F.min("text")))), width, percent)
    return found.join(again, "doc_id", "left_anti").union(many.select("doc_id").join(found, "doc_id"))


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """groups() of docs (doc_id, text) without nulls in text and in which no id but null repeats."""
    sketch = stored(docs.mapInArrow(lambda rows: _sketch(rows, width), "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary, low binary"))
    full = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = stored(reps.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low != high").select("key", "low"))
    members = stored(reps.join(buckets, "key").select("doc_id", "n", "key", "low"))
    sigs = stored(full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sig", F.col("low").alias("keys")))
    own = stored(docs.join(members.select("doc_id").distinct(), "doc_id"))
    near = members.filter("doc_id != low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    links = _confirmed(_likely(near, sigs, percent), own, width, percent)
    comp = components(links)
    labelled = members.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    labelled = stored(labelled)
    mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size")).filter("l0 != l1 AND size > 2").select("key", "size"))
    rest = stored(labelled.filter("doc_id != low").join(mixed, "key").drop("low", "component"))
    fine = own.join(rest.select("doc_id").distinct(), "doc_id").select("doc_id", "text").mapInArrow(lambda rows: _fine(rows, width), "doc_id long, fine binary")
    more = stored(_cross(rest, stored(sigs.join(fine, "doc_id")), percent))
    if more.limit(1).count():
        links = stored(links.union(_confirmed(more, own, width, percent)))
        comp = components(links)
    final = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n", "s1", "s2").join(stored(final), ["n", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that agree in slots enough."""
    least = least_slots(SLOTS, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            keep = pa.array((one == two).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    full = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    return stored(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, doc_id, n, label, sig, fine, keys, block), those of a pair of blocks together: the likely pairs across labels."""

    def found(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, i, j, ids, n, label, block = (t.column(c).to_numpy() for c in ("key", "i", "j", "doc_id", "n", "label", "block"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        fit = (label[one][:, None] != label[two][None, :]) & (100 * np.minimum(n[one][:, None], n[two][None, :]) >= percent * np.maximum(n[one][:, None], n[two][None, :]))
        if i[0] == j[0]:
            fit &= ids[one][:, None] < ids[two][None, :]
        x, y = np.nonzero(fit)
        x, y = one[x], two[y]
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        for of, least in ((sig, least_slots(SLOTS, percent)), (fine, least_slots(FINE, percent))):
            step = (1 << 23) // of.shape[1]
            keep = np.concatenate([np.zeros(0, bool)] + [(of[x[k : k + step]] == of[y[k : k + step]]).sum(axis=1) >= least for k in range(0, len(x), step)])
            x, y = x[keep], y[keep]
        # a pair is told by the first band that it shares: in that bucket it is here too, or was checked against the smallest id
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint32).reshape(-1, SLOTS // ROWS)
        equal = keys[x] == keys[y]
        told = keys[x, equal.argmax(axis=1)] == np.uint32(int(key[0]) & 0xFFFFFFFF)
        x, y = x[told], y[told]
        a, b = ids[x], ids[y]
        return np.minimum(a, b), np.maximum(a, b)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        got, at = [], 0
        keys = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for to in [*cut.tolist(), len(t)]:
            if to - at > 1:
                got.append(found(t.slice(at, to - at)))
            at = to
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], names=["a", "b"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not len(t):
            continue
        last = np.ones(len(t), bool)
        for c in ("key", "i", "j"):
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        at = len(t) - int(last[::-1].argmin() or len(t)) if not last.all() else 0
        if at:
            yield from emit(t.slice(0, at))
        held = t.slice(at)
    if held is not None and len(held):
        yield from emit(held)


def _cross(rest: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a < b) of one bucket in different components and of sizes that a link allows, each once.

    A bucket is cut into blocks of about BLOCK members, and each pair of blocks is compared in one task: no task holds a
    whole bucket, and no pair is written before it is found likely."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rest.join(sigs, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "n", "label", "sig", "fine", "keys", "block")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda rows: _compare(rows, percent), "a long, b long").distinct()


def op8_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), OP8_WIDTH, OP8_PERCENT)


#: DuckDB SQL of op8 over a relation of (doc_id, text): exact, by all pairs that share a shingle of documents whose sizes fit.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 1, 3
), elements AS (
  SELECT rep, n, unnest(s) AS e FROM classes
), common AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM elements x JOIN elements y ON x.e = y.e AND x.rep < y.rep
  AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(id, c) AS (
  SELECT rep, rep FROM classes UNION SELECT both_ways.b, reach.c FROM reach JOIN both_ways ON both_ways.a = reach.id
), comp AS (
  SELECT id, min(c) AS c FROM reach GROUP BY id
)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id, coalesce(comp.c, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN comp ON comp.id = classes.rep"""
