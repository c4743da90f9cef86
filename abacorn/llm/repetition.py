"""Quality rules on repetition inside a text, from a suffix array over its words.

A suffix array of every text (prefix doubling, many texts at once, ties alone are sorted again) gives the longest common prefixes of
neighbouring suffixes. A stack over them enumerates their intervals; those whose occurrences differ in the word before are the maximal repeated
substrings. The union of the spans of those of five words or more is the covered part. A text is kept if it has ten words, at most a fifth of its words are
covered and no repeat is longer than LONGEST words or LONGEST_PART of the text. Every text is judged by words alone, whatever their length.

Words are runs of anything but ASCII white space. Defined cases: null and empty texts have no words, so base_failed is true and kept is
false. Rows are judged one by one, repeated rows alike; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from abacorn.llm.common import arrow_schema, batch, documents, slices

LEAST_WORDS, WINDOW, COVERED_PERCENT = 10, 5, 20
LONGEST, LONGEST_PART = 200, 0.2
SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, longest_repeat long, n_maximal_repeats long, covered_fraction double"
)


def suffixes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes of texts laid end to end: suffixes in order, without those that share no four tokens with another of
    their text, and the tokens that each shares with the next (0 between texts).

    codes: a number for each token; counts: tokens of each text.
    """
    n, none = len(codes), np.zeros(0, np.int64)
    if n < 2:
        return none, none
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.cumsum(counts)[owner]
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank, active = _regroup(np.zeros(n, np.int64), order, key[order], None)
    levels, width = [rank], 1
    tied4 = None
    while len(active):
        if width >= 4 and tied4 is None:
            tied4 = active
        after = active + width
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[active]))
        placed = active[order]
        rank, active = _regroup(rank.copy(), placed, rank[placed], second[order])
        levels.append(rank)
        width *= 2
    if tied4 is None or not len(tied4):
        return none, none
    order = tied4[np.argsort(rank[tied4])]
    one, two = order[:-1], order[1:]
    common, live = np.zeros(len(one), dtype=np.int64), owner[one] == owner[two]
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + common, two + common
        inside = live & (a < end[one]) & (b < end[two])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(inside & (levels[level][a] == levels[level][b]), 1 << level, 0)
    return order, common


def repeats(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the length of the longest repeat from it: the deepest interval that holds its suffix. Lengths under 4 may show as 0."""
    longest = np.zeros(n, dtype=np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def intervals(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last place in order) of each interval of least common tokens or more that is a maximal repeat.

    before: what stands before each position, a number of its own where a text begins. An interval whose suffixes all have the same before could be
    extended to the left, so it isn't maximal; to the right it ends where its suffixes differ.
    """
    out, stack, mixed = [], [], object()
    places = np.flatnonzero(common >= least)
    after = np.flatnonzero(np.diff(places, append=-2) != 1)  # where runs of places end
    ahead, left_of = common.tolist(), before[order].tolist() if len(order) else []
    start = 0
    for stop in after:
        for i in range(places[start], places[stop] + 2):
            height = ahead[i] if i <= places[stop] else 0
            first, left = i, left_of[i]
            while stack and stack[-1][0] > height:
                length, first, held = stack.pop()
                left = held if held == left else mixed
                if left is mixed:
                    out.append((length, first, i))
            if height >= least:
                if stack and stack[-1][0] == height:
                    if stack[-1][2] != left:
                        stack[-1][2] = mixed
                else:
                    stack.append([height, first, left])
        start = stop + 1
    return out


def _regroup(rank: np.ndarray, placed: np.ndarray, first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of placed positions: where their group begins among all suffixes; and the positions that share a group."""
    new = np.ones(len(placed), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    outer = np.maximum.accumulate(np.where(new, np.arange(len(placed)), 0))
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(placed)), 0))
    rank[placed] = begin if second is None else first + begin - outer
    edges = np.flatnonzero(new)
    sizes = np.diff([*edges, len(placed)])
    return rank, placed[np.repeat(sizes, sizes) > 1]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True for positions in the span of a repeat of at least so many tokens."""
    delta = np.zeros(len(longest) + 1, dtype=np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + longest[at], -1)
    return np.cumsum(delta[:-1]) > 0


def _per_text(values: np.ndarray, counts: np.ndarray, how) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.int64)
    some = counts > 0
    if some.any():
        out[some] = how.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _summary(codes: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens in the span of a repeat, the longest repeat, and the number of maximal repeats, of least tokens or more."""
    order, common = suffixes(codes, counts)
    longest = repeats(order, common, len(codes))
    begins = (np.cumsum(counts) - counts)[counts > 0]
    before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    before[begins] = -1 - begins
    found = intervals(order, common, before, least)
    owner = np.repeat(np.arange(len(counts)), counts)
    maximal = np.bincount(owner[order[[first for _, first, _ in found]]], minlength=len(counts)) if found else np.zeros(len(counts), np.int64)
    return _per_text(covered(longest, least).astype(np.int64), counts, np.add), _per_text(np.where(longest >= least, longest, 0), counts, np.maximum), maximal


def measure(texts: list) -> dict[str, np.ndarray]:
    n = len(texts)
    words, counts = [], np.zeros(n, dtype=np.int64)
    chars, symbols, lines = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        if not text:
            continue
        found = text.encode().split()
        counts[i] = len(found)
        words += found
        chars[i] = len(text) - sum(map(text.count, SPACES))
        symbols[i] = sum(map(text.count, SYMBOLS))
        rows = [x for x in text.split("\n") if x.strip(SPACES)]
        lines[i] = len(rows) - len(set(rows))
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    cover, longest, spans = _summary(codes, counts, WINDOW)
    base = (counts < LEAST_WORDS) | (100 * cover > COVERED_PERCENT * counts)
    part = cover / np.maximum(counts, 1)
    bad = (part > COVERED_PERCENT / 100) | (longest > LONGEST) | (longest > LONGEST_PART * counts)
    return {
        "n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": cover, "base_failed": base,
        "kept": ~base & ~bad, "longest_repeat": longest, "n_maximal_repeats": spans, "covered_fraction": part,
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield batch(arrow_schema(SCHEMA), part.column("doc_id"), *measure(part.column("text").to_pylist()).values())


def repetition_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): the counts of the base rules, the suffix array's measures and the verdict."""
    return documents(docs).mapInArrow(_run, SCHEMA)
