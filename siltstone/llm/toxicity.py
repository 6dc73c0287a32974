"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades: 0 not toxic, 1 toxic, 2 severe. The labels only tell the first from the others. The toxic
rows that the model is fitted on fall into two halves, by identifier; severe ones are those that hold more than the
median of what tells toxic rows in the other half, so no row's grade rests on its own words' evidence. One weight per
feature serves all thresholds: P(grade > k) = 1 / (1 + exp(threshold[k] - score)), with score the weighted sum over the
features of a text of 1 + log(count). The expected severity is the sum of these probabilities; the grade is the number
of thresholds that the text is more likely above than not, so it is 0 exactly where the text isn't toxic.

The model is fitted on a bounded sample of the labelled rows: of each toxicity label, the SAMPLE rows whose
identifiers hash lowest, of those that are among the documents, weighted so that the labels count as they do in all
rows. Features are all that are more frequent in toxic rows of the sample than chance explains: the signed root of the
likelihood ratio statistic of their document counts is SIGNIFICANT or more. There is no limit on their number; at sf0.1
about 200 are. Only their counts in the sample reach the driver. The weight of the penalty is the one of PENALTIES
under which each half is likeliest for a model of the other. Every row and the whole text is scored.

Words are the runs of letters, digits and non-ASCII characters, A-Z lower-cased; besides whole words, stems of
STEMS characters are features, for insults that are inflected. Null text counts as empty, scored by
the thresholds alone. Labels that are null, or of documents that aren't there, are left out; labels and documents that
repeat count once. If a class is missing from the labels, no word is evidence and nothing is toxic. Repeated rows are scored row by row; an empty table gives an empty one. All columns of the input are kept;
severity, grade, p_toxic and toxic replace columns of those names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, materialize, ship, text_of

SAMPLE, GRADES = 4000, 3
#: Standard deviations beyond which a feature's share of toxic rows is no chance.
SIGNIFICANT = 4.0
#: Weights of the squared weights against the mean loss, of which the held-out rows choose.
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Lengths of stems, in characters.
STEMS = (4, 5, 6, 7)

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split()


def features_of(word: str) -> tuple[str, ...]:
    """A word, and its stems: its first characters, marked by a star."""
    return (word, *[word[:k] + "*" for k in STEMS if len(word) >= k])


def counts_of(text: str | None) -> Counter:
    return Counter(f for w in words_of(text) for f in features_of(w))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray
    #: A worker's own: what it knows of the words it met.
    memo: Memo | None = None

    def _known(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features_of(word) if f in self.weights)

    def score(self, text: str | None) -> float:
        if self.memo is None:
            self.memo = Memo(self._known, 60_000)
        counts = Counter(f for known in map(self.memo.__getitem__, words_of(text)) if known for f in known)
        self.memo.turn()
        return float(sum(self.weights[f] * (1 + np.log(n)) for f, n in sorted(counts.items())))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(words: list[str], owner: np.ndarray, column: np.ndarray, count: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float, steps: int = 300) -> Model:
    """words: the features; owner, column, count: document, feature and how often; grade and weight by document."""
    grade, weight, grades = np.asarray(grade, int), np.asarray(weight, float), GRADES
    if not grade.any() or grade.all():
        return Model({}, np.full(grades - 1, 30.0))
    weight, n = weight / weight.sum(), len(grade)
    owner, column, value = np.asarray(owner, int), np.asarray(column, int), 1 + np.log(np.asarray(count, float))
    m = len(words)
    share = [min(max(1e-6, float(weight[grade > k].sum())), 1 - 1e-6) for k in range(grades - 1)]
    # thresholds: the first, and the logarithms of the steps between them, which keeps them in order
    first = np.log((1 - share[0]) / share[0])
    gaps = np.diff([np.log((1 - s) / s) for s in share])
    x = np.concatenate([np.zeros(m), [first], np.log(np.maximum(gaps, 1e-3))])
    mean, var = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, jumps = x[:m], np.exp(x[m + 1 :])
        theta = np.concatenate([[x[m]], x[m] + np.cumsum(jumps)])
        score = np.bincount(owner, value * w[column], minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-12)
        d_score = -weight * (slope[at, grade] - slope[at, grade + 1]) / p
        d_theta = np.zeros(grades - 1)
        for k in range(grades - 1):  # threshold k is the upper end of grade k and the lower end of grade k + 1
            d_theta[k] += (-weight * slope[:, k + 1] / p)[grade == k].sum()
            d_theta[k] += (weight * slope[:, k + 1] / p)[grade == k + 1].sum()
        grad = np.zeros_like(x)
        grad[:m] = np.bincount(column, value * d_score[owner], minlength=m) + l2 * w
        grad[m] = d_theta.sum()
        for k in range(1, grades - 1):
            grad[m + k] = d_theta[k:].sum() * jumps[k - 1]
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        x = x - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-9)
    theta = np.concatenate([[x[m]], x[m] + np.cumsum(np.exp(x[m + 1 :]))])
    return Model({w: float(x[i]) for i, w in enumerate(words)}, theta)


def log_likelihood(model: Model, score: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> float:
    ends = np.concatenate([np.ones((len(score), 1)), model.above(score), np.zeros((len(score), 1))], axis=1)
    at = np.arange(len(score))
    return float((weight * np.log(np.maximum(ends[at, grade] - ends[at, grade + 1], 1e-12))).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """labels: id_col, toxic."""
    marked = labels.filter("toxic is not null").filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic") != 0).alias("bad"))
    there = marked.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    there = materialize(there, "toxicity-labels")
    total = {bool(r.bad): r.n for r in there.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    picked = None
    for side in (F.col("bad"), ~F.col("bad")):
        part = there.filter(side).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    chosen = chosen.groupBy("__id").agg(F.min("text").alias("text"), F.first("bad").alias("bad"))  # a document that repeats counts once
    chosen = materialize(chosen.select(F.monotonically_increasing_id().alias("no"), "text", "bad", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int").alias("half")), "toxicity-sample")
    held = {(r.bad, r.half): r.n for r in chosen.groupBy("bad", "half").agg(F.count("*").alias("n")).collect()}
    sizes = {bad: [held.get((bad, half), 0) for half in (0, 1)] for bad in (False, True)}
    if not (sum(sizes[True]) and sum(sizes[False])):
        return Model({}, np.full(GRADES - 1, 30.0))
    top = _telling(chosen, sizes).collect()
    words, place = [r.feature for r in top], {r.feature: i for i, r in enumerate(top)}

    def cells(batches):
        for b in batches:
            found = [{place[f]: n for f, n in counts_of(t).items() if f in place} for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), b.column(2), b.column(3)], names=["no", "place", "count", "bad", "half"])

    taken = arrow_map(chosen.select("text", "no", "bad", "half"), cells, "no long, place array<int>, count array<int>, bad boolean, half int").toPandas()
    taken = taken.sort_values("no")
    bad, half, n = taken["bad"].to_numpy(bool), taken["half"].to_numpy(int), len(taken)
    weight = np.where(bad, total[True] / sum(sizes[True]), total[False] / sum(sizes[False]))
    joined = lambda c: np.concatenate([*taken[c], np.zeros(0, int)]).astype(int)
    owner, column, count = np.repeat(np.arange(n), taken["place"].map(len)).astype(int), joined("place"), joined("count")
    told = np.array([[r.by0, r.by1, r.by_all] for r in top], bool).reshape(-1, 3)
    value = 1 + np.log(count)
    grade = bad.astype(int)
    for h in (0, 1):  # graded by what the other half tells
        evidence = np.bincount(owner, value * told[column, 1 - h], minlength=n)
        own = bad & (half == h)
        if own.any():
            grade += own & (evidence > np.median(evidence[own]))

    def fitted(rows: np.ndarray, features: np.ndarray, penalty: float) -> Model:
        use = rows[owner] & features[column]
        return fit(words, owner[use], column[use], count[use], grade, np.where(rows, weight, 0.0), penalty)

    def likelihood(penalty: float) -> float:
        """Of each half under a model of the other."""
        out = 0.0
        for h in (0, 1):
            model = fitted(half == h, told[:, h], penalty)
            w = np.array([model.weights.get(x, 0.0) for x in words]) * told[:, h]
            score = np.bincount(owner, w[column] * value, minlength=n)
            out += log_likelihood(model, score[half != h], grade[half != h], weight[half != h])
        return out

    l2 = max(PENALTIES, key=likelihood) if min(sizes[True] + sizes[False]) else PENALTIES[0]
    model = fitted(np.ones(n, bool), told[:, 2], l2)
    return Model({x: model.weights.get(x, 0.0) for x, all_ in zip(words, told[:, 2]) if all_}, model.thresholds)


def _telling(chosen: DataFrame, sizes: dict[bool, list[int]]) -> DataFrame:
    """feature, by0, by1, by_all: the features that are more frequent in toxic rows than chance explains, in which half
    or in the whole sample."""

    def run(batches):
        for b in batches:
            seen = {(bad, half): Counter() for bad in (False, True) for half in (0, 1)}
            for t, bad, half in zip(*(b.column(k).to_pylist() for k in range(3))):
                seen[bad, half].update(counts_of(t).keys())
            features = list(set().union(*seen.values()))
            columns = [pa.array([c[f] for f in features], pa.int64()) for c in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), *columns], names=["feature", "good0", "good1", "bad0", "bad1"])

    sums = [F.sum(c).alias(c) for c in ("good0", "good1", "bad0", "bad1")]
    counts = arrow_map(chosen.select("text", "bad", "half"), run, "feature string, good0 long, good1 long, bad0 long, bad1 long").groupBy("feature").agg(*sums)

    def told(halves: tuple[int, ...]):
        na, nb = sum(sizes[True][h] for h in halves), sum(sizes[False][h] for h in halves)
        if not (na and nb):
            return F.lit(False)
        a, b = (sum((F.col(f"{side}{h}") for h in halves), F.lit(0)) for side in ("bad", "good"))
        share = (a + b) / (na + nb)
        part = lambda x, n: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
        return (a * nb > b * na) & (2 * (part(a, na) + part(b, nb)) >= SIGNIFICANT**2)

    found = counts.select("feature", told((0,)).alias("by0"), told((1,)).alias("by1"), told((0, 1)).alias("by_all"))
    return found.filter("by0 OR by1 OR by_all").orderBy("feature")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows with severity double, grade int, p_toxic double and toxic boolean."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # the features of a bounded sample

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        above = own.above(np.array([own.score(t) for t in texts], float))
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype("int32"), "p_toxic": above[:, 0]})

    own = ("severity", "grade", "p_toxic", "toxic")
    base = docs.drop(*[c for c in own if c in docs.columns and c != text_col])
    out = base.withColumn("__scored", scored(text_of(text_col)))
    return out.select(*base.columns, "__scored.severity", "__scored.grade", "__scored.p_toxic", (F.col("__scored.p_toxic") >= 0.5).alias("toxic"))
