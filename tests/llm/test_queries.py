"""The registered queries on the test tables, against SQL or brute force."""

import hashlib
import zlib

import pytest

from siltstone.llm import queries

from ..compare import assert_same, connect
from .test_simhash import brute as simhash_brute
from .test_vector_dedup import brute as vector_brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLE_SQL[name]))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_op6(spark, sf):
    docs = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op6_simhash_near_dedup(spark, sf).collect()), key=str)
    assert got == simhash_brute(docs)


def test_op8(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.op8_embedding_near_dedup(spark, sf).collect()), key=str)
    assert got == vector_brute(rows)


def test_op9(spark, sf):
    df = queries.op9_resharding(spark, sf)
    rows = df.collect()
    text = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, sf).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_op1(spark, sf):
    """Against the library: ids, pieces and places."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    want = []
    for r in queries.documents(spark, sf).collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_op5(spark, sf):
    """Against the library."""
    import public_tokenizers
    import tiktoken
    from siltstone.llm.byte_bpe import load_ranks
    from siltstone.llm.common import read_bytes

    ranks = load_ranks(read_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in queries.documents(spark, sf).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op5_byte_bpe(spark, sf).collect()) == sorted(want)


def test_op10(spark, sf):
    from siltstone.llm import license_scan as L

    from .test_license_scan import words

    rows = {r.doc_id: r for r in queries.op10_license_scan(spark, sf).collect()}
    found = {r.doc_id: r for r in L.scan(queries.documents(spark, sf)).collect()}
    for d in queries.documents(spark, sf).collect():
        w, places, labels = words(d.text), [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r, own = rows[d.doc_id], {m.label for m in found[d.doc_id].matches}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(labels)), ",".join(sorted(labels | own))) and 0 <= r.score <= 1


def test_columns(spark, sf):
    want = {
        "op1_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op2_html_extraction": {"page_id", "url", "text", "n_chars"},
        "op5_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op10_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    }
    for name, columns in want.items():
        assert columns <= set(queries.QUERIES[name](spark, sf).columns)
