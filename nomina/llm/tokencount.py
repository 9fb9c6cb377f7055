"""Token counts of a unigram vocabulary by a Viterbi pass that keeps no pieces (operator 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nomina.llm.common import table
from nomina.llm.packing import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: The mark that stands for the white space before a word.
MARK = "▁"
#: What an unknown character scores below the least piece.
PENALTY = 10.0
#: Distinct words that a worker process remembers, characters of new words that are searched at once, and the length from
#: which a word is searched by itself: side by side, words cost as many steps as the longest has characters.
REMEMBER, CHUNK, LONG = 800_000, 400_000, 512
#: White space between words: the code points with the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public SentencePiece file with unigram log scores -ln(1 + id), a Zipf rule; unknown is id 0.

    The public files hold no unigram scores, so the scores are a parameter of the operator; nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(sp.id_to_piece(i), -math.log(1 + i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
    return [("<unk>", 0.0), *plain]


class Counter:
    """Pieces of words under a unigram vocabulary [(piece, score)] whose id 0 is unknown, runs of which are one piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.find.add_word(piece, (len(piece), score, i == 0))
        self.find.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > REMEMBER:
            seen.clear()
        new = sorted(set(words).difference(seen), key=len)
        while new and len(new[-1]) >= LONG:
            word = new.pop()
            seen[word] = self._count_long(word)
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (size + len(new[to]) < CHUNK or to == at):
                size += len(new[to]) + 2
                to += 1
            seen.update(zip(new[at:to], self._count(new[at:to]).tolist(), strict=True))
            at = to
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def _count_long(self, word: str) -> int:
        """One word, match after match by ascending end, longer ones first."""
        marked = MARK + word
        best, count, fused = [-math.inf] * (len(marked) + 1), [0] * (len(marked) + 1), [False] * (len(marked) + 1)
        best[0] = 0.0

        def take(j: int, i: int, score: float, unknown: bool) -> None:
            if best[i] + score > best[j]:
                best[j], count[j], fused[j] = best[i] + score, count[i] + (not (unknown and fused[i])), unknown

        now, known = 1, False  # the end at hand, and whether a piece of one character ends there
        for e, (n, score, unknown) in self.find.iter(marked):
            while now <= e:
                if not known:
                    take(now, now - 1, self.unknown, True)
                now, known = now + 1, False
            take(now, now - n, score, unknown)
            known |= n == 1
        for j in range(now, len(marked) + 1):
            if not known:
                take(j, j - 1, self.unknown, True)
            known = False
        return count[-1]

    def _count(self, words: list[str]) -> np.ndarray:
        """All words side by side: their matches come from one search; then position after position takes its best match.

        A match only replaces another of the same end if its score is greater, and longer ones come first: the rule of the
        tokenizer, which goes through starts in ascending order."""
        marked = [MARK + w for w in words]
        sizes = np.array([len(w) for w in marked])
        joined = "\n".join(marked)  # no piece holds a line feed
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        hits = [(e, n, s, u) for e, (n, s, u) in self.find.iter(joined)]
        end = np.array([h[0] for h in hits], np.int64) + 1
        length = np.array([h[1] for h in hits], np.int64)
        score = np.array([h[2] for h in hits], np.float64)
        unknown = np.array([h[3] for h in hits], bool)
        word = np.searchsorted(start, end - 1, side="right") - 1
        # characters that no piece of one character covers are unknown
        known = np.zeros(len(joined) + 1, bool)
        known[end[length == 1] - 1] = True
        chars = np.concatenate([np.arange(a, a + n) for a, n in zip(start, sizes, strict=True)])
        lone = chars[~known[chars]]
        end = np.concatenate([end, lone + 1])
        length, score = np.concatenate([length, np.ones(len(lone), np.int64)]), np.concatenate([score, np.full(len(lone), self.unknown)])
        unknown = np.concatenate([unknown, np.ones(len(lone), bool)])
        word = np.concatenate([word, np.searchsorted(start, lone, side="right") - 1])
        at = end - start[word]
        order = np.lexsort((-length, word, at))
        word, at, length, score, unknown = (x[order] for x in (word, at, length, score, unknown))
        # rank of a match among those of its word and end
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
        place = np.arange(len(word))
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        most = int(sizes.max())
        best = np.full((most + 1, len(words)), -np.inf)
        count, fused = np.zeros((most + 1, len(words)), np.int64), np.zeros((most + 1, len(words)), bool)
        best[0] = 0
        cuts = np.searchsorted(at, np.arange(most + 2))
        for j in range(1, most + 1):
            lo, hi = cuts[j], cuts[j + 1]
            r = rank[lo:hi]
            for k in range(int(r.max(initial=-1)) + 1):
                m = lo + np.flatnonzero(r == k)
                w, i = word[m], j - length[m]
                new = best[i, w] + score[m]
                better = new > best[j, w]
                m, w, i = m[better], w[better], i[better]
                best[j, w] = new[better]
                count[j, w] = count[i, w] + ~(unknown[m] & fused[i, w])
                fused[j, w] = unknown[m]
        return count[sizes, np.arange(len(words))]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for a vocabulary file: tasks that share a worker process share what it remembers."""
    if path not in _counters:
        _counters[path] = Counter(zipf_vocabulary(path))
    return _counters[path]


def split(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()


def count(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): words between white space and the pieces of each with MARK before it.

    A null or empty text has 0 of both; repeated rows and null ids are kept; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            words = [split(t or "") for t in batch.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            each = pieces([w for own in words for w in own])
            total = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total[ends] - total[ends - sizes])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op9_unigram_token_counts(spark, sf_dir) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
