import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from siltstone.llm import byte_bpe, mph

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_rows_and_round_trip(odd, texts, library):
    both = byte_bpe.decode(byte_bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in both)
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)


def test_empty_table(none):
    assert byte_bpe.decode(byte_bpe.encode(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_random_texts(library):
    own = byte_bpe.ByteBPE(byte_bpe.load_ranks(byte_bpe.read_bytes(PATH)), public_tokenizers.PATTERN)
    assert own.local
    rng = random.Random(7)
    letters = [" ", " ", "\n", "a", "B", "é", "1", "'s", ".", "\t", " ", "漢", "́", "🙂", "'", "ing", "\r", "　"]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode_ordinary(text), repr(text)
    long = "".join(rng.choice("abcde") for _ in range(30_000))
    assert np.frombuffer(own.encode(long), "<i4").tolist() == library.encode_ordinary(long)


def test_decode_of_lists():
    own = byte_bpe.ByteBPE({**{bytes([b]): b for b in range(256)}, b"ab": 300}, public_tokenizers.PATTERN)
    lists = pa.array([[1], None, [97, 300, 98], [], [300]], pa.list_(pa.int32()))
    assert own.decode_batch(lists).to_pylist() == [b"\x01", b"", b"aabb", b"", b"ab"]
    assert own.decode_batch(lists.slice(2, 3)).to_pylist() == [b"aabb", b"", b"ab"]
    assert own.decode_batch(lists.slice(1, 1)).to_pylist() == [b""] and own.decode_batch(lists.slice(0, 0)).to_pylist() == []
    covered = pa.ListArray.from_arrays(pa.array([0, 2, 3], pa.int32()), pa.array([97, 9999, 98], pa.int32()), mask=pa.array([True, False]))
    assert own.decode_batch(covered).to_pylist() == [b"", b"b"]
    for wrong in ([[301]], [[-1]], [[299]], [[97, None]], [[None]]):
        with pytest.raises(ValueError):
            own.decode_batch(pa.array(wrong, pa.list_(pa.int32())))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    made = mph.PerfectHash(keys)
    at = made.lookup(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    assert [made.place(int(k)) for k in keys[:500]] == at[:500].tolist()
    assert len(mph.PerfectHash(np.zeros(0, np.uint64)).lookup(keys[:3])) == 3
    hi = np.array([5, 5, 9], np.uint64)  # equal first halves
    index = mph.HashIndex(hi, np.array([1, 2, 3], np.uint64), np.array([10, 20, 30]), np.array([2, 2, 2]))
    index = mph.HashIndex.load(index.dump())
    found, first = index.probe(np.array([5, 5, 9, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert found.tolist() == [True, True, True, False] and first[:3].tolist() == [10, 20, 30]
