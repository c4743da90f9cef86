"""Language identification by hierarchical discrimination.

Characters one to three long, hashed into cells, describe a text by their shares (each length normalised by its own count). Linear
support vector machines first pick the language family, one against the rest, and then the language within it, one against one: each pair of
a family's languages has a machine, fitted on the rows of those two, and most votes win (of equals, the greater sum of margins, each cut at 1). They are fitted on a bounded
sample of texts of known language outside the held-out third, drawn by a hash of the id, equally for every language; the prediction adds
up the weights of the cells of every character of the whole text. A language that FAMILIES doesn't name is a family of its own.

Only the text is an input of a prediction. Defined cases: a text that is null or has no letter is `und` with score 0; if nothing can be learned
every text is. Rows are predicted one by one, repeated rows alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import arrow_schema, batch, documents, held_out, slices

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af yi lb fy",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ne ur pa gu",
    "iranian": "fa ps ku tg",
    "baltic": "lt lv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Texts of each language that the fit sees, the longest that may be among them, and languages beyond which they share what so many would see.
SAMPLE, SAMPLE_CHARS, FULL_LANGUAGES = 400, 20_000, 50
CELLS = 1 << 12
GRAMS = 3
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


def cells(text: str) -> list[np.ndarray]:
    """For each gram length the cell of every gram of text, in lower case with one space for each run of other characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where((c < 128) & ~(((c >= 97) & (c <= 122))), np.uint32(32), c)
    c = c[~((c == 32) & (np.concatenate([[0], c[:-1]]) == 32))]
    out, value = [], np.zeros(len(c), np.uint32)
    for n in range(1, GRAMS + 1):
        value = value[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n) if len(c) >= n else np.zeros(0, np.uint32)
        out.append((value * np.uint32(0x85EBCA6B)) >> np.uint32(20))
    return out


def shares(text: str) -> np.ndarray:
    """The description that the machines are fitted on."""
    out = np.zeros(CELLS, dtype=np.float32)
    for found in cells(text):
        if len(found):
            out += np.bincount(found, minlength=CELLS).astype(np.float32) / len(found)
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 100, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last one the offset) of a linear support vector machine with squared hinge loss; y: 1 or -1. Accelerated gradient steps."""
    design = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    bound = 2 * float((weight[:, None] * design**2).sum()) + penalty
    w = ahead = np.zeros(design.shape[1], np.float32)
    for step in range(rounds):
        slack = np.maximum(0, 1 - y * (design @ ahead))
        slope = penalty * ahead - 2 * design.T @ (weight * slack * y)
        following = ahead - slope / bound
        ahead = following + step / (step + 3) * (following - w)
        w = following
    return w


@dataclass
class Machines:
    """Labels of each stage and a table [cell, machine] of weights with the offsets: a machine for each family, then one for each pair of a family's languages."""

    families: list[str]
    languages: dict[str, list[str]]
    table: np.ndarray
    offsets: np.ndarray
    columns: dict[str, list[int]]
    scale: dict[str, float]


def fit(texts: list[str], langs: list[str]) -> Machines | None:
    """Machines of all languages of a sample."""
    if not texts:
        return None
    x = np.stack([shares(t) for t in texts])
    langs_ = np.array(langs)
    kin = np.array([FAMILY.get(c, c) for c in langs])
    families = sorted(set(kin))
    languages = {f: sorted(set(langs_[kin == f])) for f in families}
    weights, columns, scale = [], {}, {}

    def stage(name: str, rows: np.ndarray, target: np.ndarray, labels: list[str]) -> None:
        columns[name] = []
        if len(labels) < 2:
            return
        for label in labels:
            columns[name].append(len(weights))
            if len(labels) == 2 and label == labels[1]:  # its machine is the other one's mirror image
                weights.append(-weights[-1])
                continue
            weights.append(fit_machine(x[rows], np.where(target[rows] == label, 1.0, -1.0).astype(np.float32)))
        scale[name] = 4.0

    def pairs(name: str, labels: list[str]) -> None:
        columns[name] = []
        for one, other in combinations(labels, 2):
            rows = np.flatnonzero((langs_ == one) | (langs_ == other))
            columns[name].append(len(weights))
            weights.append(fit_machine(x[rows], np.where(langs_[rows] == one, 1.0, -1.0).astype(np.float32)))
        scale[name] = 4.0

    stage("", np.arange(len(x)), kin, families)
    for f in families:
        pairs(f, languages[f])
    all_ = np.stack(weights, axis=1) if weights else np.zeros((CELLS + 1, 0), np.float32)
    return Machines(families, languages, np.ascontiguousarray(all_[:-1]), all_[-1], columns, scale)


def predict(text: str | None, machines: Machines | None) -> tuple[str, float]:
    """(language, score): the machines' margins, through a soft maximum at each stage."""
    if machines is None or not text or not LETTER.search(text):
        return UNKNOWN, 0.0
    value = machines.offsets.astype(np.float64)
    for found in cells(text):
        if len(found):
            many = len(found) > CELLS // 4
            value = value + (np.bincount(found, minlength=CELLS).astype(np.float32) @ machines.table if many else machines.table[found].sum(axis=0, dtype=np.float64)) / len(found)
    sure, family = _choose(value, machines, "", machines.families)
    within, language = _vote(value, machines, family, machines.languages[family])
    return str(language), sure * within


def _choose(value: np.ndarray, machines: Machines, stage: str, labels: list[str]) -> tuple[float, str]:
    if len(labels) < 2:
        return 1.0, labels[0]
    margins = value[machines.columns[stage]] * machines.scale[stage]
    soft = np.exp(margins - margins.max())
    return float(soft.max() / soft.sum()), labels[int(margins.argmax())]


def _vote(value: np.ndarray, machines: Machines, stage: str, labels: list[str]) -> tuple[float, str]:
    """The label that wins most of its pairs, and the soft maximum of its margins against the others'; for two labels as in _choose."""
    if len(labels) < 2:
        return 1.0, labels[0]
    margins = np.zeros((len(labels), len(labels)))
    for (one, other), margin in zip(combinations(range(len(labels)), 2), value[machines.columns[stage]]):
        margins[one, other], margins[other, one] = margin, -margin
    wins = margins > 0
    best = int(np.lexsort((-np.arange(len(labels)), np.clip(margins, -1, 1).sum(axis=1), wins.sum(axis=1)))[-1])
    against = np.delete(margins[best], best) * 2 * machines.scale[stage]
    return float(1 / (1 + np.exp(np.minimum(-against, 700)).sum())), labels[best]


def learn(docs: DataFrame) -> Machines | None:
    """Fit on docs (doc_id, text, lang): at most SAMPLE texts on average for each language reach the driver, fewer beyond FULL_LANGUAGES."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out()).where(F.length("text") <= SAMPLE_CHARS)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    each = max(1, min(SAMPLE, SAMPLE * FULL_LANGUAGES // len(counts)))
    shares_ = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, each / r["count"]) * 1_000_000))))
    share = F.coalesce(F.element_at(shares_, F.col("lang")), F.lit(0))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < share)
    rows = drawn.select("doc_id", "text", "lang").orderBy("doc_id", "text").limit(2 * each * len(counts)).collect()
    rows = [r for r in rows if LETTER.search(r["text"])]
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [predict(t, sent.value) for t in part.column("text").to_pylist()]
            yield batch(arrow_schema(SCHEMA), part.column("doc_id"), *zip(*found))

    out = documents(docs).mapInArrow(run, SCHEMA)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
