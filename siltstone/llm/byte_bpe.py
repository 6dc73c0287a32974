"""Byte-level BPE, encoding and decoding, by a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash over the vocabulary's bytes,
checked against the bytes stored at the number found. All others are merged pair by pair: their bytes are a
linked list, the candidate pairs a heap by rank, and pairs that have changed meanwhile are skipped when they
come up.

Texts: null counts as empty; empty gives no ids and no bytes. Very long texts and pre-tokens cost n log n.
Repeated rows and repeated identifiers are encoded row by row; a null identifier is passed on; an empty table
gives an empty one. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Memo, arrow_map, read_bytes, text_of
from .mph import PerfectHash

#: Words, and pre-tokens, whose ids a worker remembers, twice at most.
WORDS, PIECES = 200_000, 400_000
#: Fixed value: the pattern that splits at single spaces and line feeds as encode() says.
LOCAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x.strip())}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = list(ranks)
        self.hash = PerfectHash(np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64))
        at = self.hash.lookup(np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64))
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(self.vocabulary)
        for i, w in zip(at.tolist(), self.vocabulary):
            self.slots[i] = (w, ranks[w])
        #: by id its bytes; null where the vocabulary has no such id
        of = {i: w for w, i in ranks.items()}
        self.bytes_of = pa.array([of.get(i) for i in range(max(of, default=-1) + 1)], pa.binary())
        self.single = [ranks[bytes([b])] for b in range(256)]
        # by the left id and the right one, the id of their joined bytes
        self.pairs: list[dict[int, int]] = [{} for _ in range(max(ranks.values(), default=0) + 1)]
        for w, i in ranks.items():
            for k in range(1, len(w)):
                if (a := ranks.get(w[:k])) is not None and (b := ranks.get(w[k:])) is not None:
                    self.pairs[a][b] = i
        # the same of two bytes; -1: none
        self.two = [[self.pairs[a].get(b, -1) for b in self.single] for a in self.single]
        self.pieces, self.words = Memo(lambda p: None, PIECES), Memo(lambda w: None, WORDS)
        self.local = pattern == LOCAL

    def merge(self, piece: bytes) -> list[int]:
        """The heap over linked bytes. An entry is the rank of a pair, which is the id it becomes, and its place; it
        counts only as long as the pair at that place still has that rank."""
        n, pairs, two = len(piece), self.pairs, self.two
        single = self.single
        ids = [single[b] for b in piece]
        if n == 1:
            return ids
        at = [two[a][b] for a, b in zip(piece, piece[1:])]  # by place, the rank of the pair that begins there
        shift = 12 if n < 4096 else 40  # small numbers are compared faster
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(at) if r >= 0]
        heapify(heap)
        at.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & low
            r = entry >> shift
            if at[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], at[j] = r, -1, -1
            if k < n:
                before[k] = i
                at[i] = new = pairs[r].get(ids[k], -1)
                if new >= 0:
                    heappush(heap, new << shift | i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                at[h] = new = pairs[ids[h]].get(r, -1)
                if new >= 0:
                    heappush(heap, new << shift | h)
        return [x for x in ids if x >= 0]

    def _learn(self, pieces: list[str]) -> None:
        """Fills the memo of pre-tokens: the perfect hash for all at once, the heap for those it misses."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        at = self.hash.lookup(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64))
        slots, own, merge = self.slots, self.pieces, self.merge
        for piece, x, i in zip(pieces, raw, at.tolist()):
            word, rank = slots[i] if i >= 0 else (b"", -1)
            ids = array("i", (rank,) if word == x else merge(x))
            if sys.byteorder == "big":
                ids.byteswap()
            own[piece] = ids.tobytes()

    def _join(self, split: list[list[str]]) -> list[bytes]:
        """The ids of lists of pre-tokens."""
        if fresh := self.pieces.unknown(set().union(*split)):
            self._learn(fresh)
        get = self.pieces.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers.

        Pre-tokens never reach over a single space or a single line feed between two characters that aren't white
        space, but for the space itself, which begins the next one. So texts are cut there into words, which repeat
        and are remembered. Texts with other white space between words are split whole."""
        for memo in (self.words, self.pieces):
            memo.turn()
        if not self.local:
            return self._join([self.pattern.findall(t) for t in texts])
        cut = [self._words(t) for t in texts]
        words = self.words
        if fresh := words.unknown(set().union(*cut)):
            inside = [w for w in fresh if not self._open(w)]
            for w in fresh:
                words[w] = None
            for w, ids in zip(inside, self._join([self.pattern.findall(w) for w in inside])):
                words[w] = ids
        out, whole = [], []
        for k, x in enumerate(cut):
            try:
                out.append(b"".join(map(words.__getitem__, x)))
            except TypeError:  # None among them
                out.append(b"")
                whole.append(k)
        for k, ids in zip(whole, self._join([self.pattern.findall(texts[k]) for k in whole])):
            out[k] = ids
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words with the space before them, and line feeds."""
        if "\n" not in text:
            return text.replace(" ", "\0 ").split("\0") if "\0" not in text else ["\0"]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else ["\0"]

    @staticmethod
    def _open(word: str) -> bool:
        """Whether white space at an end might join what is outside."""
        if word == "\n":
            return False
        bare = word[1:] if word[:1] == " " else word
        return not bare or bare[0].isspace() or bare[-1].isspace() or "\0" in bare

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode_batch(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids; a null list counts as empty. The bytes of all ids, one after the other, are
        the bytes of all lists: only the ends differ."""
        ids = lists.flatten()  # without what null lists cover
        if ids.null_count or len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(self.bytes_of):
            raise ValueError("an id outside the vocabulary, or null")
        found = self.bytes_of.take(ids)
        if found.null_count:
            raise ValueError("an id outside the vocabulary")
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int32, len(found) + 1, found.offset * 4) if len(found) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[ends].astype(np.int32).tobytes()), data if data is not None else pa.py_buffer(b"")])


def kept_bpe(blob: bytes, pattern: str) -> ByteBPE:
    if (key := ("bpe", zlib.crc32(blob), pattern)) not in KEPT:
        KEPT[key] = ByteBPE(load_ranks(blob), pattern)
    return KEPT[key]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, ids array<int>; with `decoded` also decoded binary, the bytes that the ids give back."""
    blob = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))  # a fixed file of under 1 MB

    def run(batches):
        bpe = kept_bpe(blob.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                lists = _lists(bpe.encode_batch(part.column(1).to_pylist()))
                columns = [part.column(0), lists, *([bpe.decode_batch(lists)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    source = docs.select(id_col, text_of(text_col).alias("text"))
    return arrow_map(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocabulary: str, pattern: str = LOCAL, id_col: str = "doc_id") -> DataFrame:
    """id_col, ids, decoded binary. A null list of ids counts as empty; an id outside the vocabulary is an error."""
    blob = encoded.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def run(batches):
        bpe = kept_bpe(blob.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bpe.decode_batch(part.column(1))], names=[id_col, "ids", "decoded"])

    source = encoded.select(id_col, F.col("ids").cast("array<int>").alias("ids"))
    return arrow_map(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")
