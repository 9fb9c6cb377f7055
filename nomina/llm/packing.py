"""Best-fit packing of token sequences by bin completion (operator 5)."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import octets, stored, table

CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Search nodes in all, fillings of one sequence that are tried, and steps in finding those; None lifts a limit.
NODES, FILLINGS, STEPS = 64, 6, 400
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files are: the importable public_tokenizers, else the folder they are kept in."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


#: Bytes of text that are cut into units at once, and distinct units that a worker process remembers.
SLICE, REMEMBER = 1 << 22, 700_000
#: Classes of bytes: 0 white space, 1 letters, 2 punctuation that ends a run of letters, 3 whatever else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[[ord(c) for c in ".,!?;:%&*#$"]] = 2
#: Second bytes of the letters of Latin-1 in UTF-8, after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs for times and division


def unit_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without white space, offsets of units in them, each text's first unit) of texts side by side.

    A unit is a run between white space, cut also where a run of letters and one of punctuation meet: the vocabulary
    cuts at all these places, whatever stands around them, so the ids of units follow one another."""
    n = len(raw)
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[_LATIN[raw[lead + 1]]]
    kind[lead], kind[lead + 1] = 1, 1
    there = kind != 0
    cut = np.zeros(n + 1, bool)
    np.not_equal(there[1:], there[:-1], out=cut[1:n])  # ends of runs too: a cut at white space is one at what follows it
    cut[1:n] |= (kind[1:] + kind[:-1] == 3) & there[1:] & there[:-1]
    cut[offsets] = True
    before = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    np.cumsum(there, out=before[1:])
    at = before[cut]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return raw[there], at, np.searchsorted(at, before[offsets])


class TokenIds:
    """32-bit ids of texts. A distinct unit is encoded once and remembered, up to a bound; new runs of letters are encoded
    side by side as one text: each is one unit of the vocabulary, whose last id, and no other, ends a unit."""

    def __init__(self, path: str, limit: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side and the n + 1 offsets of the texts in them."""
        data, at, first = unit_runs(raw, offsets)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        _, ends, flat = units.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(units.dictionary) + 1].tolist()
        flat = flat.to_pybytes() if flat is not None else b""
        own = [flat[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.seen) > self.limit:
            self._clear()
        place = list(map(self.seen.get, own))
        if None in place:
            self._learn([u for u, n in zip(own, place, strict=True) if n is None])
            place = [self.seen[u] if n is None else n for u, n in zip(own, place, strict=True)]
        unit = np.array(place, np.int64)[np.asarray(units.indices)]
        size = self.size[unit]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[unit] - ends[:-1], size)
        where += np.arange(ends[-1])
        return self.ids[where], ends[first]

    def _learn(self, new: list[bytes]) -> None:
        letters = [u for u in new if u.isalpha() or u.decode().isalpha()]
        if letters:
            ids = np.array(self.tok.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(cut) == len(letters) + 1 and cut[-1] == len(ids):
                self._keep(letters, ids, np.diff(cut))
                new = [u for u in new if not (u.isalpha() or u.decode().isalpha())]
            # else some letter decomposes to a letter and a mark: two units
        got = [e.ids for e in self.tok.encode_batch_fast([u.decode() for u in new], add_special_tokens=False)]
        self._keep(new, np.array([i for g in got for i in g], "<u4"), np.array([len(g) for g in got], np.int64))

    def _keep(self, units: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n, to = len(self.seen), self.used + len(ids)
        self.ids, self.start, self.size = (_room(x, k) for x, k in ((self.ids, to), (self.start, n + len(units)), (self.size, n + len(units))))
        self.ids[self.used : to] = ids
        self.size[n : n + len(units)], self.start[n : n + len(units)] = size, self.used + np.cumsum(size) - size
        self.seen.update(zip(units, range(n, n + len(units)), strict=True))
        self.used = to


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


_encoders: dict[str, TokenIds] = {}


def encoder(path: str) -> TokenIds:
    """This process's encoder of a vocabulary file: tasks that share a worker process share what it remembers."""
    if path not in _encoders:
        _encoders[path] = TokenIds(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END, cut only where longer than capacity.

    A null or empty text is the one id END; repeated rows are packed as often as they stand there; a null id is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(path), np.array([END], "<u4")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            docs_, text = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            # the vocabulary lower-cases; its special tokens, which it looks for first, are in lower case
            text = pc.if_else(pc.match_substring(text, "<|"), text, pc.ascii_lower(text))
            raw, offsets, _ = octets(text)
            at = 0
            while at < len(docs_):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
                flat, first = ids(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                for doc, a, b in zip(docs_[at:to], first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for piece, low in enumerate(range(0, b - a + 1, capacity)):
                        part = flat[a + low : min(b, a + low + capacity)]
                        if len(part) < capacity and a + low + len(part) == b:
                            part = np.append(part, end)
                        for col, v in zip(out, (doc, piece, low, len(part), zlib.crc32(part)), strict=True):
                            col.append(v)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: A pattern: how many sequences, and what each of them holds as ((size, how many), ...).
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram counts[size].

    Sequences of equal content are one entry; a size adds at most four entries, so there are at most 4 * capacity."""
    open_: dict[int, list] = {}  # room -> [[times, content]]
    rooms = [0] * (capacity + 1)  # entries of each room
    used: list[int] = []  # rooms with entries, ascending
    done: list[Pattern] = []
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            i = bisect_left(used, size)
            if i == len(used):
                most = capacity // size
                times, fit = (left // most, most) if left >= most else (1, left)
                left -= times * fit
                room, content = capacity - size * fit, ((size, fit),)
            else:
                at = used[i]
                entry = open_[at][-1]
                fit = min(at // size, left)
                times = min(entry[0], left // fit)
                content = (*entry[1], (size, fit))
                left -= times * fit
                entry[0] -= times
                if not entry[0]:
                    open_[at].pop()
                    rooms[at] -= 1
                    if not rooms[at]:
                        used.pop(i)
                room = at - size * fit
            if room:
                open_.setdefault(room, []).append([times, content])
                rooms[room] += 1
                if rooms[room] == 1:
                    insort(used, room)
            else:
                done.append((times, content))
    return done + [(t, c) for entries in open_.values() for t, c in entries]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: all tokens over the capacity, and pieces over half of it with what can't join them."""
    n, mass = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    k = np.arange(capacity // 2 + 1)
    half = n[capacity - k] - n[capacity // 2]
    room = half * capacity - (mass[capacity - k] - mass[capacity // 2])
    small = mass[capacity // 2] - np.where(k > 0, mass[k - 1], 0)
    least = n[-1] - n[capacity - k] + half + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(mass[-1]) // capacity), int(least.max()))


def completions(counts: np.ndarray, largest: int, capacity: int, limit: int | None = None, steps: int | None = None) -> list[tuple]:
    """Fillings beside a piece of the largest size, least waste first, none dominated by another: ((size, how many), ...).

    A filling is dominated if one with a larger piece in place of one of its own, or with one piece more, fits: whatever the
    rest of a packing with the lesser one holds, it can swap those pieces. The search goes from large to small pieces;
    with `steps` it stops after so many, and with `limit` only so many fillings are told."""
    sizes = [int(s) for s in np.flatnonzero(counts[: capacity - largest + 1])[::-1]]
    found: list[tuple[int, tuple]] = []
    budget = -1 if steps is None else steps

    def undominated(room: int, picked: tuple) -> bool:
        left = {s: int(counts[s]) for s in sizes}
        for s, m in picked:
            left[s] -= m
        return not any(left[x] for x in sizes if x <= room) and not any(left[x] for s, _ in picked for x in sizes if s < x <= s + room)

    def go(i: int, room: int, picked: tuple) -> bool:
        """False once the search is over."""
        nonlocal budget
        if budget == 0:
            return False
        budget -= 1
        while i < len(sizes) and sizes[i] > room:
            i += 1
        if i == len(sizes):
            if undominated(room, picked):
                found.append((room, picked))
            return limit is None or len(found) < limit or found[-1][0] > 0
        for j in range(i, len(sizes)):
            s = sizes[j]
            for m in range(min(int(counts[s]), room // s), 0, -1):
                if not go(j + 1, room - m * s, (*picked, (s, m))):
                    return False
        return True

    go(0, capacity - largest, ())
    if not found:  # stopped before the first: large pieces first
        picked, room = (), capacity - largest
        for s in sizes:
            m = min(int(counts[s]), room // s)
            picked, room = (*picked, (s, m)) if m else picked, room - m * s
        found.append((room, picked))
    return [f for _, f in sorted(found, key=lambda f: f[0])[:limit]]


def pack(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = NODES, fillings: int | None = FILLINGS, steps: int | None = STEPS) -> list[Pattern]:
    """Patterns that hold counts[size] pieces of each size in as few sequences as the search finds.

    The incumbent is best-fit decreasing. While it exceeds the lower bound, bin completion branches over the undominated
    fillings of one sequence around the largest piece left, and over how often a filling is used: as often as the counts
    allow, half as often and so on down to once. A branch ends where its sequences and the bound on what is left reach the
    incumbent, or where the same pieces were left before with no more sequences; at each node the best fit of what is left
    may become the incumbent. The state is the histogram, of capacity + 1 numbers, whatever the number of documents.
    With nodes, fillings and steps None the search is whole and its result a least number of sequences; else the best
    packing found within them stands."""
    best = best_fit(counts, capacity)
    used = lambda p: sum(t for t, _ in p)
    goal, most = lower_bound(counts, capacity), used(best)
    visited: dict[bytes, int] = {}
    stack: list[tuple] = [(counts, None, 0)]  # what is left, the patterns so far as nested pairs, their sequences
    left = -1 if nodes is None else nodes
    while stack and most > goal and left != 0:
        counts, done, n = stack.pop()
        key = counts.tobytes()
        if n + lower_bound(counts, capacity) >= most or visited.get(key, n + 1) <= n:
            continue
        visited[key] = n
        left -= 1
        rest = best_fit(counts, capacity) if done else best
        if n + used(rest) < most:
            most, best = n + used(rest), rest
            at = done
            while at:
                at, last = at
                best = [*best, last]
        if most == goal or not counts.any():
            continue
        largest = int(np.flatnonzero(counts)[-1])
        own = counts.copy()
        own[largest] -= 1
        tries = []
        for filling in completions(own, largest, capacity, fillings, steps):
            content = tuple(sorted((Counter({largest: 1}) + Counter(dict(filling))).items(), reverse=True))
            need = np.zeros(len(counts), np.int64)
            need[[s for s, _ in content]] = [m for _, m in content]
            times = min(int(counts[s]) // m for s, m in content)
            while times:
                tries.append((counts - times * need, (done, (times, content)), n + times))
                times //= 2
        stack += reversed(tries)  # the least waste, as often as it goes, is tried first
    return best


def layout(patterns: list[Pattern], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of pieces of one size: the r-th piece of a size (from `low`) goes to sequence seq + (r - low) // many, there at
    offset + (r - low) % many * size. There are at most 4 * capacity patterns of under 91 sizes, whatever the documents."""
    taken, seq, runs = {}, 0, []
    for times, content in patterns:
        offset = 0
        for s, many in content:
            low = taken.get(s, 0)
            taken[s] = low + times * many
            runs.append((s, low, seq, offset, many))
            offset += s * many
        seq += times
    runs.sort()
    return {k: np.array([r[i] for r in runs], np.int64) for i, k in enumerate(("size", "low", "seq", "offset", "many"))}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with doc_id, piece, start, length, ids_crc32) and sequence_id and offset.

    The driver gets the histogram of lengths, at most `capacity` rows, and sends out the runs of layout(), whose number the
    capacity bounds too. Pieces of a length are numbered by counts of stretches of a hash of their row, repeated rows or not,
    so that a common length needs no single task."""
    names = cut.columns
    rows = stored(cut.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs = layout(pack(counts, capacity), capacity)
    share = rows.groupBy("length").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_parts"))
    rows = rows.join(F.broadcast(share), "length").withColumn("_p", F.pmod("_h", "_parts"))  # at most `capacity` rows
    sums = rows.groupBy("length", "_p").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("length").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("length", "_p", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("length", "_p").orderBy("_h", "doc_id", "piece", "start")) - 1
    rows = rows.withColumn("_r", rank).join(sums, ["length", "_p"])
    rows = rows.select(*names, (F.col("_before") + F.col("_r")).alias("_rank"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    span = int(counts.max()) + 1
    sent = cut.sparkSession.sparkContext.broadcast(runs | {"key": runs["size"] * span + runs["low"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(r["key"], size * span + rank, side="right") - 1
            step = rank - r["low"][at]
            seq, offset = r["seq"][at] + step // r["many"][at], r["offset"][at] + step % r["many"][at] * size
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, out)


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(pieces(docs, vocabulary_path()))
