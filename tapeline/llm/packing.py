"""Best-fit packing of token sequences: best-two-fit.

Tokens are made once per distinct word: the tokenizer drops white space, so a text's tokens are
its words' tokens in a row. Documents are cut into pieces only where they are longer than a
sequence. Blocks of pieces are packed on their own: each sequence is filled greedily with the
longest piece that fits; then, if two unpacked pieces fill the gap and the place of the smallest
piece more tightly, they replace it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import query, table, utf8, words
from tapeline.session import materialize

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = b"\0\0\0\0"  # id 0 after each document
#: Pieces packed together; a sequence never takes pieces of two blocks.
BLOCK = 16_384
_SEPARATOR, _SEPARATOR_ID = "<|endoftext|>", 49407
_CACHED_WORDS = 400_000
#: Marks that may close a word and never join its letters in one token.
_MARKS = b".,;:!?\"'()[]{}<>#*$%&|-_+=~^/\\@`"
_AT_ONCE = 500


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the
    next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokens:
    """Token ids of words as little-endian 32-bit bytes, remembered up to a bound.

    Words of plain letters and closing marks, nearly all of them, take a short way: the same
    vocabulary as ranks, with a zero byte for the end of a word. The tokenizer itself does the rest.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.marks = Tokenizer.from_file(path), {}, {b"": b""}
        with open(path, encoding="utf-8") as f:
            vocabulary, letters = json.load(f)["model"]["vocab"], _byte_letters()
        ranks = {}
        for token, i in vocabulary.items():
            ends = token.endswith("</w>") and len(token) > 4
            ranks[bytes(letters[c] for c in (token[:-4] if ends else token)) + b"\0" * ends] = i
        self.letters = tiktoken.Encoding("letters", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closing[[i for token, i in ranks.items() if token.endswith(b"\0")]] = True

    def learn(self, found: set[bytes]) -> None:
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        plain, other = [], []
        for w in found:
            if w not in self.known:
                core = w.rstrip(_MARKS)
                (plain if _plain(core) else other).append((w, core))
        cores = list({core for _, core in plain})
        made = dict(zip(cores, self._letters(cores), strict=True)) if cores else {}
        for w, core in plain:
            self.known[w] = made[core] + self._mark(w[len(core):])
        self.known.update(self._others([w for w, _ in other]))

    def _letters(self, cores: list[bytes]) -> list[bytes]:
        ids = np.array(self.letters.encode_ordinary(" ".join([c.decode().lower() + "\0" for c in cores])), "<u4")
        ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
        packed = ids.tobytes()
        return [packed[4 * s:4 * e] for s, e in zip([0, *ends], ends)]

    def _mark(self, marks: bytes) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > _CACHED_WORDS:
                self.marks = {b"": b""}
            self.marks[marks] = self._whole(marks)
        return self.marks[marks]

    def _whole(self, w: bytes) -> bytes:
        return np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _others(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        odd = [w for w in new if _SEPARATOR.encode() in w]
        rest = [w for w in new if _SEPARATOR.encode() not in w] if odd else new
        for lo in range(0, len(rest), _AT_ONCE):
            some = rest[lo:lo + _AT_ONCE]
            ids = np.array(self.tokenizer.encode(_SEPARATOR.join([w.decode() for w in some]), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(ids == _SEPARATOR_ID)
            starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
            packed = ids.tobytes()
            yield from zip(some, [packed[4 * s:4 * e] for s, e in zip(starts, ends, strict=True)], strict=True)
        for w in odd:
            yield w, self._whole(w)

    def encode(self, w: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, w))


def _plain(core: bytes) -> bool:
    """Letters of the Latin blocks only, which neither composition nor lower case takes apart."""
    if core.isalpha():
        return True
    text = core.decode()
    return text.isalpha() and max(text) < "\u0250" and max(text.lower()) < "\u0250"


def folded_words(text: bytes | None) -> list[bytes]:
    """The words in lower case (A-Z), as the tokenizer makes them anyway; a text that may name a
    special token stays as it is."""
    return words(text if text is None or b"<|" in text else text.lower())


_loaded: dict[str, WordTokens] = {}


def word_tokens(vocabulary: str) -> WordTokens:
    """The tokenizer of this worker; ``vocabulary`` is a path or a name among the public files."""
    if vocabulary not in _loaded:
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _loaded[vocabulary] = WordTokens(path)
    return _loaded[vocabulary]


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the documents' tokens, cut at ``capacity``."""
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a bounded set of new words at a time
                part = b.slice(lo, 256)
                texts = [folded_words(t) for t in utf8(part, "text")]
                tokens.learn(set().union(*texts))
                row, piece, start, length, crc = [], [], [], [], []
                for i, w in enumerate(texts):
                    ids = tokens.encode(w) + END
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at:at + step]
                        row.append(i), piece.append(k), start.append(at // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id}` {dict(docs.dtypes)[id]}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; lengths are 1 to ``capacity``."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        stacks[n].append(i)
    # bit n of ``left``: some piece of length n is unpacked; bit capacity - n of ``mirror`` likewise
    left = sum(1 << n for n in range(1, capacity + 1) if stacks[n])
    mirror = sum(1 << (capacity - n) for n in range(1, capacity + 1) if stacks[n])
    upto = [(2 << n) - 1 for n in range(capacity + 1)]
    where, offset, sequence = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def take(n: int) -> int:
        nonlocal left, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            left ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    while left:
        inside, gap = [], capacity
        while fits := left & upto[gap]:
            n = fits.bit_length() - 1
            inside.append(take(n))
            gap -= n
        if gap and left and len(inside) > 1:
            smallest = lengths[inside[-1]]
            for total in range(gap + smallest, smallest, -1):
                pairs = left & (mirror >> (capacity - total)) & upto[total - 1]
                if not total & 1 and pairs >> (total >> 1) & 1 and len(stacks[total >> 1]) < 2:
                    pairs ^= 1 << (total >> 1)
                if pairs:
                    n = pairs.bit_length() - 1
                    out = inside.pop()
                    inside += [take(n), take(total - n)]
                    stacks[smallest].append(out)
                    left |= 1 << smallest
                    mirror |= 1 << (capacity - smallest)
                    break
        at = 0
        for i in inside:
            where[i], offset[i] = sequence, at
            at += lengths[i]
        sequence += 1
    return where, offset


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one token that ends every document. Repeated rows are packed as
    often as they come; an empty table gives no rows; other columns aren't read. Pieces are dealt
    evenly to blocks of bounded size, so neither a source nor a repeated row can fill a task.
    """
    cut = materialize(pieces(docs, id, text, capacity, vocabulary), "pieces")
    parts = max(1, -(-cut.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 40, [], 0

        def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal first
            rows = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            where, offset = best_two_fit(rows.column(rows.schema.get_field_index("length")).to_pylist(), capacity)
            where += first
            first = int(where.max()) + 1
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(where), pa.array(offset)], names=[*rows.schema.names, "sequence_id", "offset"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= 2 * block:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return cut.repartition(parts).mapInArrow(run, f"`{id}` {dict(docs.dtypes)[id]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op6_packing")
def _op6(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
