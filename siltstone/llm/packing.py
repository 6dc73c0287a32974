"""Best-fit packing of tokenised documents: bounded-space online best fit.

Each task packs the rows it reads, with no shuffle: it holds a fixed number of open bins in a bitset keyed by
free space. A piece goes to the open bin with the least free space that still takes it: shift the bitset by the
piece's length and take the lowest bit. If none takes it, a bin is opened; if too many are open, the fullest
closes first. Pieces of one batch of rows are offered longest first, which is still online from batch to batch.

Only documents longer than a sequence are cut, into pieces of the sequence's length; the last may be shorter.
Null texts count as empty; an empty text still has its end token. Ties (equal lengths) go in input order.
Repeated rows and repeated or null identifiers are packed row by row. An empty table gives an empty one. Other
columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import KEPT, Memo, arrow_map, read_bytes, text_of

#: Open bins of a task.
OPEN_BINS = 4096
#: Bytes of ids of the pieces that are offered longest first, together.
LOOK = 16 << 20
#: Words, and their parts, whose ids a worker remembers, twice at most.
WORDS, PARTS = 50_000, 200_000


class BestFit:
    """place(length) -> (bin, offset)"""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} in sequences of {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # this one is the fullest itself: it closes
                    return number, self.capacity - free
                self._take(fullest)
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def byte_letters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordEncoder:
    """The ids of a text by the `tokenizers` library, part by part: this vocabulary's normaliser and splitter
    drop white space and never look across it. A text of common Latin characters is lower-cased and split here and
    only its parts, which repeat and are remembered, go to the library's model, which saves most of its time. In other
    texts that holds of their words one by one, and words with other characters, or that may hold a special token, go
    through the whole library."""

    #: Characters that lower-casing and composition treat one by one; white space apart.
    SIMPLE = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]*")
    LINES = re.compile("[ \n!-~\u00c0-\u012f\u0131-\u017f]*")
    #: Fixed value: the vocabulary's own splitting pattern, for those characters.
    PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \na-z\u00df-\u00f6\u00f8-\u017f0-9]+")

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words, self.parts = Memo(self._word, WORDS), Memo(self._part, PARTS)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self.letters[b] for b in part.encode()])
        return _little([t.id for t in self.model.tokenize(part)])

    def _word(self, word: str) -> bytes:
        if self.SIMPLE.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(word.lower())))
        return _little(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if self.LINES.fullmatch(text) and "<|" not in text:
            out = b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))
        else:
            out = b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
            self.words.turn()
        self.parts.turn()
        return out


def _little(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def kept_encoder(blob: bytes) -> WordEncoder:
    if (key := ("words", zlib.crc32(blob), len(blob))) not in KEPT:
        KEPT[key] = WordEncoder(blob)
    return KEPT[key]


def rows_of(batches):
    """(identifier, text, the identifiers' type), a few rows at a time as Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, 200):
            part = b.slice(k, 200)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield doc, text, b.schema.field(0).type


def pack(docs: DataFrame, tokenizer: str, sequence: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS, look: int = LOOK) -> DataFrame:
    """One row per piece: id_col, piece int, start long, length long, sequence_id long, offset long, ids binary
    (little-endian unsigned 32-bit, as in a token file). Sequences are at most `sequence` long."""
    blob = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer))  # a fixed file of under 2 MB
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, bins = kept_encoder(blob.value), BestFit(sequence, open_bins)
        high = TaskContext.get().partitionId() << 36
        names = [id_col, "piece", "start", "length", "sequence_id", "offset", "ids"]
        held: list[tuple] = []

        def emit():
            order = sorted(range(len(held)), key=lambda i: -held[i][3])
            rows = []
            for i in order:
                number, offset = bins.place(held[i][3])
                rows.append((*held[i][:4], high + number, offset, held[i][4]))
            kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500]), kinds)], names=names)
            held.clear()

        kind, size = None, 0
        for doc, text, kind in rows_of(batches):
            ids = encode(text) + end
            size += len(ids)
            for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                part = ids[at : at + 4 * sequence]
                held.append((doc, piece, at // 4, len(part) // 4, part))
            if size >= look:
                yield from emit()
                size = 0
        if held:
            yield from emit()

    source = docs.select(id_col, text_of(text_col).alias("text"))
    return arrow_map(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, piece int, start long, length long, sequence_id long, offset long, ids binary")
