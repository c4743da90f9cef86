"""Toxicity by maximum-scoring segments of token log-odds.

Learning: every labelled document outside the held-out third is counted token by token on the cluster, each token at most PER_DOC times a document; log-odds of toxic against clean
with an informative Dirichlet prior (the pooled counts) give each word and each stem (the first STEM letters of a longer word) a z-score,
and those with z above a threshold keep their log-odds less a
standard deviation. A token scores its word's log-odds or else its stem's; all others score
the drift, a small negative. Scoring: the linear scan over cumulative sums finds every maximal-scoring segment of the
whole text (disjoint passages, each with the property that every prefix and suffix of it scores positive). Scores of segments become
E-values by extreme-value statistics: lambda solves sum p exp(lambda s) = 1 over clean token frequencies p, and a text of n tokens
expects K n exp(-lambda S) segments of score S or more by chance; K is the likeliest for the best scores of clean documents of the sample, those without a
segment counted as below the least score. Segments with E below SIGNIFICANT are the toxic passages; the text's
evidence is the log E of all of them together, and a logistic curve fitted on a bounded sample of the learning part turns it into the score.

Only the text is an input of a score. Defined cases: null, empty and token-free texts have no segment and get the score of a text
without evidence. Labels repeated for a document count once (toxic if any says so); null labels don't count. With no toxic label to learn
from every score is 0. Rows are scored one by one, repeated rows alike; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import arrow_schema, batch, broadcast_if_small, documents, held_out, materialise, slices

#: A run of letters and marks, for Java and for regex alike.
LETTERS = r"[\p{L}\p{M}]+"
TOKEN = regex.compile(LETTERS)
#: z-score from which a token's log-odds count; toxic documents in which one must occur;
#: occurrences of a token that a document may count.
LEAST_Z, LEAST_DOCS, PER_DOC = 4.0, 3, 4
STEM, MARK = 5, "-"
#: Weight of the prior, as a part of all counts; score of a token that doesn't count; least and highest score of one that does.
PRIOR, DRIFT, LEAST, TOP = 0.05, -0.02, 2.0, 6.0
SIGNIFICANT = 0.05
#: Documents on which the logistic curve is fitted.
CURVE_DOCS = 20_000
CUT = 0.7
SCHEMA = "doc_id long, score double, predicted int, n_passages int, passages string"


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    constant: float = 1.0
    slope: float = 0.0
    base: float = -1000.0


def segments(scores: np.ndarray, places: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score): scores of the tokens at places, drift (negative) at all others.

    Each new positive token is a segment; while an earlier one starts lower and ends lower than it, they merge with all between.
    """
    total, last = 0.0, -1
    held: list[tuple[float, float, int, int]] = []  # sums before and after, first and last place
    for s, at in zip(scores.tolist(), places.tolist()):
        total += drift * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        left, first = total, at
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= total:
                held.append((left, total, first, at))
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(first, at, after - before) for before, after, first, at in held]


def passages(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Tokens of text, and its segments as (first token, last token, score, E-value)."""
    tokens = TOKEN.findall(text.lower()) if text else []
    get, stem = model.scores.get, model.stems.get
    found = [(j, s) for j, w in enumerate(tokens) if (s := get(w) or (stem(w[:STEM]) if len(w) > STEM else None))]
    if not found:
        return len(tokens), []
    runs = segments(np.array([s for _, s in found]), np.array([j for j, _ in found]))
    return len(tokens), [(a, b, s, model.constant * len(tokens) * math.exp(-model.rate * s)) for a, b, s in runs]


def evidence(runs: list[tuple[int, int, float, float]]) -> float:
    """-log E of the significant passages together: 0 without any."""
    return sum(-math.log(max(e, 1e-300)) for *_, e in runs if e < SIGNIFICANT)


def score_of(evidence_: float, model: Model) -> float:
    x = model.base + model.slope * math.log1p(evidence_)
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def extreme_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum shares exp(lambda scores) = 1; the drift makes the mean negative."""
    low, high = 1e-6, 1.0
    value = lambda x: float((shares * np.exp(x * scores)).sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return low


def fit_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """(base, slope) of the logistic curve over log(1 + evidence), by Newton steps with a small ridge; times: how often each point counts."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (times * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (times * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents outside the held-out third; the tokens that pass LEAST_Z, LEAST and LEAST_DOCS reach the driver, and counted evidence values."""
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    marked = materialise(marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    known = docs.join(broadcast_if_small(marked), "doc_id").where("text is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    each = known.select("toxic", F.explode(_counted(words)).alias("t")).groupBy("t.token", "toxic").agg(F.count("*").alias("n"), F.sum("t.first").alias("docs"))
    sides = materialise(each.groupBy("token").agg(*(F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)), F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("docs1")), "tokens")
    stem = F.col("token").startswith(MARK)
    total = {r["stem"]: (float(r["n0"]), float(r["n1"])) for r in sides.groupBy(stem.alias("stem")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    (clean, toxic), stems = total.get(False, (0.0, 0.0)), total.get(True, (0.0, 0.0))
    if not clean or not toxic:
        return Model()
    prior = F.lit(PRIOR) * (F.col("n0") + F.col("n1"))

    def odds(n: str, side: int) -> Column:
        """Of words among words, of stems among stems, with the prior's share of all counts of the kind."""
        all_ = F.when(stem, stems[side] + PRIOR * sum(stems)).otherwise((clean, toxic)[side] + PRIOR * (clean + toxic))
        return F.log((F.col(n) + prior) / (all_ - F.col(n) - prior))

    delta = odds("n1", 1) - odds("n0", 0)
    spread = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    rated = sides.withColumn("z", delta / spread).withColumn("delta", delta - spread)  # a standard deviation on the safe side
    picked = rated.where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST) & (F.col("docs1") >= LEAST_DOCS)).orderBy(F.desc("z"), "token")
    rows = picked.select("token", "delta", "n0").collect()
    if not rows:
        return Model()
    scored = {r["token"]: min(TOP, r["delta"]) for r in rows}
    model = Model({w: s for w, s in scored.items() if w[0] != MARK}, {w[1:]: s for w, s in scored.items() if w[0] == MARK})
    # shares of clean words by the score they get: a word's own, or else its stem's
    counts = {r["token"]: float(r["n0"]) for r in rows}
    for word in model.scores:
        if len(word) > STEM and MARK + word[:STEM] in counts:
            counts[MARK + word[:STEM]] -= counts[word]
    scores, shares = np.array([*scored.values(), DRIFT]), np.array([max(0.0, counts[w]) / clean for w in scored])
    shares = np.append(shares, max(0.0, 1 - shares.sum())) + 1e-9
    model.rate = extreme_rate(scores, shares / shares.sum())
    share = min(1.0, CURVE_DOCS / max(1, marked.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "toxic")
    model.constant = _constant(sample.where("toxic = 0"), model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch(arrow_schema("x double, toxic int"), [math.log1p(evidence(passages(t, sent.value)[1])) for t in part.column("text").to_pylist()], part.column("toxic"))

    # a logarithm of at most 21 in steps of a thousandth: few rows, whatever the sample
    seen = sample.mapInArrow(rate, "x double, toxic int").groupBy(F.round("x", 3).alias("x"), "toxic").count().orderBy("x", "toxic").toPandas()
    x, y, times = (seen[c].to_numpy(dtype=float) for c in ("x", "toxic", "count"))
    if len(set(y)) == 2:
        model.base, model.slope = fit_curve(x, y, times)
    return model


def _counted(words: Column) -> Column:
    """The tokens (words, and stems behind MARK) that a document counts: each at most PER_DOC times, first once. Arrays of one element bind names."""
    stems = lambda w: F.transform(F.filter(w, lambda x: F.length(x) > STEM), lambda x: F.concat(F.lit(MARK), F.substring(x, 1, STEM)))
    ordered = F.transform(F.array(words), lambda w: F.array_sort(F.concat(w, stems(w))))
    kept = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("token"), F.when((i > 0) & (F.get(s, i - 1) == x), 0).otherwise(1).alias("first"), ((i >= PER_DOC) & (F.get(s, i - PER_DOC) == x)).alias("over"))), lambda t: ~t["over"])
    return F.flatten(F.transform(ordered, kept))


def _constant(clean: DataFrame, model: Model) -> float:
    """K from clean documents of the sample: those with a segment, by the sum of n exp(-lambda best score), LEAST standing in for a best score that isn't there."""
    sent = clean.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [passages(t, sent.value) for t in part.column("text").to_pylist()]
            tops = [max((s for _, _, s, _ in runs), default=0.0) for _, runs in found]
            yield batch(arrow_schema("some int, mass double"), [int(s > 0) for s in tops], [n * math.exp(-model.rate * max(s, LEAST)) for (n, _), s in zip(found, tops)])

    some, mass = clean.select("text").mapInArrow(best, "some int, mass double").agg(F.sum("some"), F.sum("mass")).first()
    return max(0.5, some or 0) / mass if mass else 1.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id, text): score, predicted, and the significant passages as first:last token."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [passages(t, sent.value)[1] for t in part.column("text").to_pylist()]
            toxic = [[r for r in runs if r[3] < SIGNIFICANT] for runs in found]
            scores = [score_of(evidence(runs), sent.value) for runs in found]
            yield batch(arrow_schema(SCHEMA), part.column("doc_id"), scores, [int(s >= CUT) for s in scores], list(map(len, toxic)), [",".join(f"{a}:{b}" for a, b, *_ in runs) for runs in toxic])

    return docs.mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels (doc_id, toxic) and score every row of docs: doc_id, held_out, score, predicted, n_passages, passages."""
    docs = documents(docs)
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that are not predicted toxic."""
    from abacorn.llm.common import keep_rows

    sent = docs.sparkSession.sparkContext.broadcast(learn(documents(docs), labels))
    return keep_rows(docs, lambda texts: [score_of(evidence(passages(t, sent.value)[1]), sent.value) < CUT for t in texts])
