import corpus_pipeline as P
import numpy as np
import public_tokenizers
from siltstone.llm.common import materialize
from tokenizers import Tokenizer


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, sf), "test")
        if name == "packing":
            break
        assert out.columns == columns
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert set(after) <= set(before) and len(rows) == len(after)
        if name == "toxicity":
            assert all(after[i] == before[i] for i in after)
            assert sum(labels.get(i) == 0 for i in after) >= 0.95 * sum(v == 0 for v in labels.values())
            assert sum(labels.get(i) == 1 for i in after) <= 0.5 * sum(v == 1 for v in labels.values())
        if name == "line_dedup":
            assert set(after) == set(before)
            long = [x.strip().lower() for t in after.values() for x in set(t.split("\n")) if len(x.strip()) >= 10]
            assert len(long) == len(set(long)) or max(map(long.count, set(long))) == 1
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            assert 0 < len(after) <= len(before) and all(after[i] == before[i] for i in after)
            assert len(set(after.values())) == len(after)
        docs, before = out, after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.piece)):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert whole == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in before.items()}


def test_near_copies_go(spark, sf):
    words = [f"w{i * 7919 % 1009}" for i in range(300)]
    near = list(words)
    near[100] = near[200] = "changed"
    rows = [(5, " ".join(words), "en", "s", 1), (3, " ".join(near), "en", "s", 1), (4, "all of another kind", "en", "s", 1), (None, " ".join(words), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.keep_one_of_near_copies(spark, docs, sf)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, None]
    assert P.keep_one_of_near_copies(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_near_copies_are_those_of_their_shingles(spark, sf):
    """Similarities on both sides of 0.8, from 5 shingles to 200, repeated shingles and a repeated identifier."""
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.choice([8, 9, 30, 200]))]
        other = list(words)
        for at in rng.integers(0, len(words), max(1, len(words) // rng.integers(45, 60))):
            other[at] = "changed"
        texts[2 * k] = " ".join(words[: len(words) - len(words) % 2 if k % 3 else None])
        texts[2 * k + 1] = " ".join(words[:-1] if k % 2 else other + ["and again the very same"] * 9 if k % 5 == 0 else other)
    sets = {i: {tuple(w[a : a + 5]) for w in [t.split()] for a in range(max(1, len(w) - 4))} for i, t in texts.items()}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in texts if i % 2 == 0}
    assert sum(x >= 0.8 for x in share.values()) > 20 and sum(0.6 < x < 0.8 for x in share.values()) > 20
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()] + [(1000, texts[0], "en", "s", 1), (1000, "a text of its own here", "en", "s", 1), (1001, "a text of its own here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = {r.doc_id for r in P.keep_one_of_near_copies(spark, docs, sf).collect()}
    assert set(texts) - kept == {i + 1 for i, x in share.items() if x >= 0.8} and not kept & {1000, 1001}
