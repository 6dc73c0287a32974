import math
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, limit):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts)
    pieces, bins = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= limit
        pieces.setdefault(str(r.doc_id), []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    got = []
    for i, parts in pieces.items():
        parts.sort(key=lambda r: (r.piece, r.start))
        whole = {}
        for r in parts:
            whole.setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
        copies = len(whole[0])
        ids = [x for s in sorted(whole) for x in whole[s][0]]
        assert [r.start for r in parts if r.start == r.piece * limit] == [r.start for r in parts]
        if i != "None":
            got += [(i, ids)] * copies
    assert sorted(got) == [w for w in want if w[0] != "None"]
    return len(bins), sum(len(ids) for _, ids in want)


def test_odd_rows(odd, texts):
    check(packing.pack(odd, PATH, sequence=64).collect(), texts, 64)
    check(packing.pack(odd, PATH, sequence=64, open_bins=1, look=1).collect(), texts, 64)


def test_empty_table(none):
    assert packing.pack(none, PATH).count() == 0


def test_documents_fill_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n, total = check(packing.pack(docs, PATH).collect(), texts, 4096)
    assert n <= math.ceil(total / 4096) + 1


def test_bounded_bins():
    rng = random.Random(3)
    for most in (1, 2, 50):
        bins, used, open_at_once = packing.BestFit(100, most), {}, 0
        for _ in range(3000):
            length = rng.randint(1, 100)
            number, offset = bins.place(length)
            assert used.get(number, 0) == offset
            used[number] = offset + length
            open_at_once = max(open_at_once, bins.open)
            # the bitset says what is open
            assert {f for f in range(101) if bins.bits >> f & 1} == set(bins.by_free)
        assert max(used.values()) <= 100 and open_at_once <= most


def test_best_fit_takes_the_fullest_that_fits():
    bins = packing.BestFit(10)
    assert [bins.place(x) for x in (6, 7, 3, 4, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    bins.place(5), bins.place(8)  # 5 and 2 free
    assert bins.place(6) == (2, 0)  # fits neither: the bin with 2 free closes
    assert bins.place(2) == (2, 6) and bins.place(5) == (0, 5)


def test_encoder_equals_the_library():
    tokenizer, own = Tokenizer.from_file(PATH), packing.WordEncoder(packing.read_bytes(PATH))
    rng = random.Random(5)
    letters = [" ", " ", "\n", "a", "B", "é", "1", "'s", ".", "\t", " ", "漢", "́", "🙂", "İ", "ŉ", "<|endoftext|>", "½", "\u0085", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
