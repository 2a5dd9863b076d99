"""Token counts: the number of unigram pieces of a text, without making the pieces.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at each place of a
word, longest first; one pass of dynamic programming carries the best score to each place and the
number of pieces on that path. Ties go to the path whose last piece starts first, and a character
that is no piece costs the least score less ten and counts one token per UTF-8 byte: the rules of
the public ``tokenizers`` library's Unigram model with byte fallback, after a split at white space
and a leading mark on every word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import query, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The white space of Unicode, which the split takes out.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORDS = re.compile(f"[^{SPACES}]+")
_CACHED_WORDS = 400_000
_AT_ONCE = 2_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of words, remembered up to a bound."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton, self.known = ahocorasick.Automaton(), {}
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def learn(self, found: set[str]) -> None:
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        new = [w for w in found if w not in self.known]
        for lo in range(0, len(new), _AT_ONCE):
            some = new[lo:lo + _AT_ONCE]
            self.known.update(zip(some, self.count_all(some), strict=True))

    def count_all(self, words: list[str]) -> list[int]:
        """Counts of all words in one scan: no piece has white space, so none crosses a gap."""
        text = " ".join([MARK + w for w in words])
        score, count, at = [-inf] * (len(text) + 1), [0] * (len(text) + 1), 0
        ends = []
        for w in words:
            score[at] = 0.0
            at += len(w) + 2
            ends.append(at - 1)
        strange = [i for i, c in enumerate(text) if c not in self.single and c != " "] if set(text) - self.single - {" "} else []
        waiting = iter(strange)
        place = next(waiting, None)
        for end, (length, s) in self.automaton.iter(text):
            while place is not None and place < end:
                self._unknown(text, place, score, count)
                place = next(waiting, None)
            start = end + 1 - length
            total = score[start] + s
            if total > score[end + 1]:
                score[end + 1] = total
                count[end + 1] = count[start] + 1
        while place is not None:
            self._unknown(text, place, score, count)
            place = next(waiting, None)
        return [count[e] for e in ends]

    def _unknown(self, text: str, i: int, score: list[float], count: list[int]) -> None:
        """A character that is no piece, after every piece that ends with it."""
        total = score[i] + self.unknown
        if total > score[i + 1]:
            score[i + 1] = total
            count[i + 1] = count[i] + len(text[i].encode())


_loaded: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """The counter of this worker; ``vocabulary`` is a path or a name among the public files."""
    if vocabulary not in _loaded:
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _loaded[vocabulary] = Counter(load_pieces(path))
    return _loaded[vocabulary]


def units(text: str | None) -> list[str]:
    """The words of a text as they meet the vocabulary, each without its leading mark."""
    found = _WORDS.findall(text) if text else []
    return [u for w in found for u in w.removeprefix(MARK).split(MARK)] if text and MARK in text else found


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: id, n_words (long), n_tokens (long).

    A null or empty text has no words and no tokens. Repeated rows stay; an empty table gives no
    rows; other columns aren't read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a bounded set of new words at a time
                part = b.slice(lo, 256)
                texts = [units(t) for t in part.column(1).to_pylist()]
                pieces.learn(set().union(*texts))
                look = pieces.known.__getitem__
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([sum(map(look, w)) for w in texts], pa.int64())],
                                                 names=["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id]}, n_words long, n_tokens long")
    return rows.withColumnRenamed("id", id)


@query("op8_token_counts")
def _op8(spark, sf_dir):
    return counted(table(spark, sf_dir, "documents"))
