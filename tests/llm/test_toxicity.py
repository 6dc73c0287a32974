import random

import numpy as np
import pytest

from siltstone.llm import toxicity as T


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("ab cdefgh".replace(" ", "")) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["moron", "idiot", "scum", "vilex" + rng.choice(["a", "bo", "cee"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1800)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels[:1200], "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = range(1200, 1800)
    assert sum(out[i].toxic for i in held if i % 6 == 0) >= 95 and sum(out[i].toxic for i in held if i % 6) <= 3
    assert all(0 <= r.severity <= T.GRADES - 1 and 0 <= r.grade < T.GRADES for r in out.values())
    # shared weights: more evidence, more severity
    a, b, c = (model.above(np.array([model.score(t)])).sum() for t in ("fine words", "you moron", "you moron idiot scum moron vilexa"))
    assert a < b < c


def test_training_is_deterministic(spark):
    rows, labels = corpus(600)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = T.train(docs, marks), T.train(docs.repartition(5), marks.repartition(3))
    assert one.weights.keys() == two.weights.keys()
    text = "moron words and idiot"
    assert one.above(np.array([one.score(text)]))[0, 0] == pytest.approx(two.above(np.array([two.score(text)]))[0, 0], abs=0.02)


def test_sample_is_bounded(spark):
    rows, labels = corpus(600)
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=40)
    assert model.above(np.array([model.score("you moron idiot scum")]))[0, 0] > 0.5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (99, 1), (None, 0)], "doc_id long, toxic int")
    out = T.score(odd, T.train(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.p_toxic <= 1 for r in out)
    assert set(odd.columns) <= set(T.score(odd, T.train(odd, labels)).columns)
    assert T.score(none, T.train(none, labels)).count() == 0
    blind = T.train(odd, labels.limit(0))
    assert not any(r.toxic for r in T.score(odd, blind).collect())


def test_scores_by_brute_force(spark, odd, texts):
    """Every score from the definition: words by a regular expression, features counted one by one."""
    import math
    import re

    rows, labels = corpus(600)
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def p_above(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        counts = {}
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
            for f in [word] + [word[:k] + "*" for k in T.STEMS if len(word) >= k]:
                counts[f] = counts.get(f, 0) + 1
        score = math.fsum(model.weights[f] * (1 + math.log(n)) for f, n in counts.items() if f in model.weights)
        return [1 / (1 + math.exp(min(max(t - score, -60), 60))) for t in model.thresholds]

    for df, pairs in ((odd, texts), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        want = sorted(((i, round(sum(p), 9), sum(x >= 0.5 for x in p), round(p[0], 9), p[0] >= 0.5) for i, p in ((i, p_above(t)) for i, t in pairs)), key=str)
        assert sorted(((r.doc_id, round(r.severity, 9), r.grade, round(r.p_toxic, 9), r.toxic) for r in T.score(df, model).collect()), key=str) == want


def test_held_out_labels(spark):
    """A fifth of the labels is held out."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = T.train(docs, labels.filter("doc_id % 5 <> 0"))
    held = labels.filter("doc_id % 5 = 0 and toxic is not null").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    out = T.score(docs.dropDuplicates(["doc_id"]).join(held.select("doc_id"), "doc_id"), model).select("doc_id", "toxic", "grade").withColumnRenamed("toxic", "found").join(held, "doc_id").collect()
    toxic, found = sum(r.toxic for r in out), sum(r.found for r in out if r.toxic)
    flagged = sum(r.found for r in out)
    print("held out:", len(out), "toxic", toxic, "found", found, "flagged", flagged, "features", len(model.weights))
    assert toxic > 60 and found >= 0.85 * toxic and flagged - found <= 0.01 * (len(out) - toxic)
    assert all((r.grade > 0) == r.found for r in out)


def test_labels_of_absent_documents_and_repeats(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    absent = [(10_000 + i, 1) for i in range(500)]
    model = T.train(docs, spark.createDataFrame(labels * 2 + absent, "doc_id long, toxic int"), sample=100)
    once = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=100)
    assert model.weights.keys() == once.weights.keys()
    for text in ("you moron idiot scum", "fine words"):
        assert model.above(np.array([model.score(text)]))[0, 0] == pytest.approx(once.above(np.array([once.score(text)]))[0, 0], abs=0.02)


def test_fit_shares_weights_across_thresholds():
    """Two features; the gradient steps reach a point where small changes don't lower the loss."""
    owner, column, count = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1]), np.ones(4)
    model = T.fit(["good*", "bad"], np.r_[owner, 2], np.r_[column, 0], np.r_[count, 1], np.array([0, 0, 1, 2, 0]), np.ones(5), 1e-4)
    assert model.weights["bad"] > model.weights["good*"] and model.thresholds[0] < model.thresholds[1]
