"""Benchmark decontamination by pigeonhole edit matching.

An item whose error budget is k edits is split into k + 1 pieces; a passage within k edits of it must hold one piece unchanged. An
Aho-Corasick automaton of all pieces finds every exact piece hit in every whole text, and each place that a hit points to is verified
with Myers' bit-parallel distance of the item to the best substring there. Texts and items are compared as lower-case text with white space runs
as one space. The budget is a tenth of an item's characters, rounded down.

Items come in blocks of bounded size, each a broadcast automaton and a pass over its own, so the benchmark may grow. Documents are never
shuffled. Defined cases: null texts and texts without a word match nothing, and neither do items without a word. Items of fewer than SHORT characters
have no budget and must stand as they are between characters that are no letters or digits. Items of equal text match alike. Each row of docs gives a row for each item that it holds (the best match, the earliest of equals), repeated rows too.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from abacorn.llm.common import arrow_schema, batch, documents, slices

ERROR_RATE, SHORT = 0.1, 8
#: Characters of items in one automaton, a node of some 60 bytes each at most.
BLOCK_CHARS = 4_000_000
#: Length of the grams of the count filter before Myers.
GRAM = 4
#: Cells of an item's gram table.
CELLS = 8192
SCHEMA = "doc_id long, item_id long, distance int, budget int, match_start long, match_end long"


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def gram_cells(text: str) -> np.ndarray:
    """A cell of the gram table for each gram of text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    value = np.zeros(n, np.uint32)
    for j in range(GRAM):
        value = value * np.uint32(0x9E3779B1) + c[j : j + n]
    return (value * np.uint32(0x85EBCA6B)) >> np.uint32(19)


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up text."""
    edges = [len(text) * j // (budget + 1) for j in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def myers(masks: dict[str, int], length: int, text: str) -> list[int]:
    """Distance of a pattern to the best substring that ends at each position of text. masks: the pattern's positions of each character."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, out = full, 0, length, []
    for c in text:
        match = masks.get(c, 0)
        x = match | down
        horizontal = (((match & up) + up) ^ up) | match
        rise, fall = down | ~(horizontal | up) & full, up & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = (fall | ~(x | rise)) & full, rise & x
        out.append(score)
    return out


@functools.lru_cache(maxsize=4096)
def _tables(pattern: str) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """Positions of each character of an item from its start and from its end, and its gram table."""
    masks, back = defaultdict(int), defaultdict(int)
    for j, c in enumerate(pattern):
        masks[c] |= 1 << j
        back[c] |= 1 << len(pattern) - 1 - j
    grams = np.zeros(CELLS, dtype=bool)
    grams[gram_cells(pattern)] = True
    return dict(masks), dict(back), grams


class Items:
    """The automaton of a block of items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.rows, self.automaton = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            text = normalise(text)
            if not text:
                continue
            budget = int(len(text) * ERROR_RATE)
            for offset, piece in pieces(text, budget):
                at[piece].append((len(self.rows), offset + len(piece)))
            self.rows.append((item_id, text, budget))
        for piece, places in at.items():
            self.automaton.add_word(piece, tuple(places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item's place, distance, budget, start, end) of each item in a normalised text, the best match of each."""
        if not self.rows or not text:
            return []
        begins: dict[int, list[int]] = defaultdict(list)
        for end, places in self.automaton.iter(text):
            for item, after in places:
                begins[item].append(end + 1 - after)
        out, cells = [], gram_cells(text) if begins else None
        for item, starts in begins.items():
            found = self._best(item, sorted(set(starts)), text, cells)
            if found:
                out.append((item, *found))
        return sorted(out)

    def _best(self, item: int, starts: list[int], text: str, cells: np.ndarray) -> tuple[int, int, int, int] | None:
        _, pattern, budget = self.rows[item]
        length = len(pattern)
        if length < SHORT:
            alone = (s for s in starts if not text[max(0, s - 1) : s].isalnum() and not text[s + length : s + length + 1].isalnum())
            return next(((0, 0, s, s + length) for s in alone), None)
        if (at := text.find(pattern)) >= 0:
            return 0, budget, at, at + length
        runs: list[list[int]] = []
        for s in starts:
            low, high = max(0, s - budget), min(len(text), s + length + budget)
            if high - low < length - budget:
                continue
            if runs and low <= runs[-1][0] + 2 * budget:
                runs[-1][1] = max(runs[-1][1], high)
            else:
                runs.append([low, high])
        best, (masks, back, grams) = None, _tables(pattern)
        # a match keeps all grams of the item but GRAM for each edit, each at a position of its own
        least = length - GRAM + 1 - budget * GRAM
        for low, high in runs:
            if np.count_nonzero(grams[cells[low : high - GRAM + 1]]) < least:
                continue
            scores = myers(masks, length, text[low:high])
            distance = min(scores)
            if distance <= budget and (best is None or distance < best[0]):
                end = low + scores.index(distance) + 1
                reverse = myers(back, length, text[low:end][::-1])
                best = (distance, budget, end - 1 - reverse.index(distance), end)
        return best


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, text) in blocks of about BLOCK_CHARS; the driver holds one at a time."""
    held, chars = [], 0
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row[0], row[1]))
        chars += len(row[1])
        if chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _on_worker(shared) -> Items:
    """A worker's own automaton of a broadcast block."""
    rows = shared.value
    if not isinstance(getattr(shared, "_built", None), Items):
        shared._built = Items(rows)
    return shared._built


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and benchmark item within the item's error budget: doc_id, item_id, distance, budget, and the match in the normalised text."""
    docs, out = documents(docs), None
    for held in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches, shared=shared):
            block = _on_worker(shared)
            for part in slices(batches):
                rows = [(i, block.rows[f[0]][0], *f[1:]) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for f in block.find(normalise(t))]
                if rows:
                    yield batch(arrow_schema(SCHEMA), *zip(*rows))

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are."""
    for held in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches, shared=shared):
            block = _on_worker(shared)
            for part in slices(batches):
                yield part.filter(pa.array([not block.find(normalise(t)) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
