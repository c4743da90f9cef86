"""Packing by minimum bin slack: a bitset subset-sum picks the multiset of remaining lengths that fills a window closest to capacity.

Every document is tokenised and ends with one separator id. Whole windows of a long document are sequences of their own; what remains
of each document is an item. An item anchors a window with the largest remaining length; the dynamic program over a bitset of
reachable sums finds the multiset of other lengths whose sum is closest to the rest, with counts from backtracking, and the pattern
is used as often as the counts allow. Windows of a task that no multiset fills exactly wait for later documents of that task, and at its
end they are filled up by cutting, so that a task leaves one sequence short of capacity at most. No row is shuffled; a task holds the
token ids of a bounded number of documents at once.

Defined cases: a null text counts as empty, and an empty text is the separator alone. Rows are packed one by one, so repeated rows and
repeated or null ids are packed as often as they occur. Other columns of the input are not read. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from abacorn.llm.common import arrow_schema, batch, documents, slices

CAPACITY, SEPARATOR, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Bytes of text that a task tokenises at once, so that each distinct word is split once.
CHARS = 6_000_000
#: Token ids that a task holds before it packs what it has.
TOKENS_AT_ONCE = 4_000_000
#: Parts of words whose ids a Python worker remembers in each of two generations, and those that are encoded in one text.
PARTS_KEPT, PARTS_AT_ONCE = 500_000, 4000
#: The tokenizer's own rule for parts of lower-case text, the end of the letters for which it holds as it stands here, and words for which it doesn't.
PARTS, LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+", "\u0250"
OWN_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER = r"[^\x{0}-\x{24f}]|\x{130}|<\|"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))


@functools.lru_cache(maxsize=4)
def _part_tokenizer(path: str | None):
    """The tokenizer without the steps that PARTS and lower case have done already; None if its own steps are others than these."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = _tokenizer(path)
    steps = [json.loads(x.__getstate__()) if x is not None else {} for x in (whole.normalizer, whole.pre_tokenizer)]
    kinds = [[(n["type"], n.get("pattern")) for n in x.get("normalizers", x.get("pretokenizers", []))] for x in steps]
    if kinds != [[("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)], [("Split", {"Regex": OWN_PARTS}), ("ByteLevel", None)]]:
        return None
    out = Tokenizer(whole.model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def _gather(table: np.ndarray, lengths: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of table (of lengths, end to end) that picked names, end to end, and the length of each."""
    starts, each = np.cumsum(lengths) - lengths, lengths[picked]
    return table[np.repeat(starts[picked] - (np.cumsum(each) - each), each) + np.arange(each.sum())], each


def _encode(parts: list[str], path: str | None) -> list[bytes]:
    """Ids, as little-endian 32-bit numbers, of each part. Latin parts are joined: each ends with a token that ends a word."""
    tokenizer, light, ends = _tokenizer(path), _part_tokenizer(path), _word_ends(path)
    plain = [i for i, p in enumerate(parts) if (p.isascii() or max(p) < LATIN) and "<|" not in p]
    other = sorted(set(range(len(parts))).difference(plain))
    out: list = [None] * len(parts)
    for low in range(0, len(plain), PARTS_AT_ONCE):
        some = plain[low : low + PARTS_AT_ONCE]
        ids = np.array(light.encode_batch_fast([" ".join([parts[i] for i in some])], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, after = ids.tobytes(), 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(after) != len(some):
            other += some
            continue
        before = 0
        for i, end in zip(some, after.tolist()):
            out[i] = raw[before:end]
            before = end
    for i, encoded in zip(other, tokenizer.encode_batch_fast([parts[i] for i in other], add_special_tokens=False)):
        out[i] = np.array(encoded.ids, dtype="<u4").tobytes()
    return out


@functools.lru_cache(maxsize=4)
def _word_ends(path: str | None) -> np.ndarray:
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        out[i] = token.endswith("</w>")
    return out


class Known:
    """Ids, as little-endian 32-bit numbers, that a Python worker remembers from task to task, by part and in two generations: what was not asked
    for while a generation filled up is forgotten."""

    def __init__(self, path: str | None, kept: int = PARTS_KEPT) -> None:
        self.path, self.kept, self.young, self.old = path, kept, {}, {}

    def ids(self, parts: list[str]) -> list[bytes]:
        out = list(map(self.young.get, parts))
        new = [i for i, held in enumerate(out) if held is None]
        found = list(map(self.old.get, map(parts.__getitem__, new)))
        unknown = [i for i, held in zip(new, found) if held is None]
        for i, held in zip(new, found):
            out[i] = held
        for i, held in zip(unknown, _encode([parts[i] for i in unknown], self.path)):
            out[i] = held
        self.young.update((parts[i], out[i]) for i in new)
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        return out


def _split(words: pa.Array) -> pa.ListArray:
    """The parts of words that the tokenizer encodes apart: Latin words as its own rule splits them, any other word as one part."""
    latin = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(words), "[\\x{85}\\x{a0}]", " "), PARTS, "\\0 ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.if_else(pc.match_substring_regex(words, OTHER), words, latin)))


def token_ids(texts: pa.Array, known: Known) -> list[np.ndarray]:
    """Ids of each text and the separator. Where the tokenizer splits words as PARTS does, each distinct part is encoded once; any other
    tokenizer encodes whole texts."""
    tail = np.array([SEPARATOR], dtype="<u4")
    if _part_tokenizer(known.path) is None:
        whole = _tokenizer(known.path).encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
        return [np.concatenate([np.array(x.ids, dtype="<u4"), tail]) for x in whole]
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = found.flatten().dictionary_encode()
    split = _split(words.dictionary)
    parts = split.flatten().dictionary_encode()
    held = known.ids(parts.dictionary.to_pylist())
    table = np.frombuffer(b"".join(held), dtype="<u4")
    ids, each = _gather(table, np.fromiter(map(len, held), np.int64, len(held)) // 4, parts.indices.to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy(zero_copy_only=False)]
    flat, each = _gather(ids, np.diff(ends), words.indices.to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(each)])[found.offsets.to_numpy(zero_copy_only=False)]
    return [np.concatenate([flat[a:b], tail]) for a, b in zip(ends[:-1], ends[1:])]


def least_slack(counts: dict[int, int], lengths: list[int], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to target of lengths within their counts, and how often it takes each. lengths: those with counts, in falling order."""
    reach, steps, mask = 1, [], (1 << (target + 1)) - 1
    for length in lengths:
        if length > target:
            continue
        left, times = min(counts[length], target // length), 1
        while left:
            times = min(times, left)
            left -= times
            wider = (reach | reach << length * times) & mask
            if wider != reach:
                steps.append((length, times, reach))
                reach = wider
            times *= 2
        if reach >> target:
            break
    total = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return total, taken


class Packer:
    """Packs items, (doc_id, start, ids, doc_tokens), of one task; rows: the pieces placed so far."""

    def __init__(self, first: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity, self.rows = first, capacity, []
        self.items: dict[int, list] = {}

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._window([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self._put((doc_id, whole, ids[whole:].copy(), len(ids)))

    def _put(self, item: tuple) -> None:
        self.items.setdefault(len(item[2]), []).append(item)

    def _take(self, length: int) -> tuple:
        item = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
        return item

    def _window(self, items: list) -> None:
        offset = 0
        for doc_id, start, ids, tokens in items:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def fill(self, last: bool = False) -> None:
        """Place what fills windows exactly; with last, all that is left, cutting items to fill up."""
        counts = {n: len(x) for n, x in self.items.items()}
        lengths = sorted(counts, reverse=True)
        waiting: dict[int, int] = {}
        while lengths:
            anchor = lengths[0]
            counts[anchor] -= 1
            total, taken = least_slack(counts, lengths, self.capacity - anchor)
            counts[anchor] += 1
            pattern = {**taken, anchor: taken.get(anchor, 0) + 1}
            if total + anchor == self.capacity:
                for _ in range(times := min(counts[n] // used for n, used in pattern.items())):
                    self._window([self._take(n) for n, used in pattern.items() for _ in range(used)])
                for n, used in pattern.items():
                    counts[n] -= used * times
            elif last:
                items = [self._take(n) for n, used in pattern.items() for _ in range(used)]
                for n, used in pattern.items():
                    counts[n] -= used
                slack = self.capacity - total - anchor
                rest = [n for n in lengths if counts[n]]
                if rest:  # every one is longer than the slack, or the multiset would hold it
                    doc_id, start, ids, tokens = self._take(rest[0])
                    counts[rest[0]] -= 1
                    items.append((doc_id, start, ids[:slack], tokens))
                    self._put((doc_id, start + slack, ids[slack:], tokens))
                    counts[len(ids) - slack] = counts.get(len(ids) - slack, 0) + 1
                self._window(items)
                lengths = sorted(counts, reverse=True)
            else:
                waiting[anchor] = waiting.get(anchor, 0) + 1
                counts[anchor] -= 1
            lengths = [n for n in lengths if counts[n]]


@functools.lru_cache(maxsize=4)
def _known(path: str | None) -> Known:
    return Known(path)


def _pack(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    packer, known, held = Packer(TaskContext.get().partitionId() << 33), _known(path), 0
    for part in slices(batches, chars=CHARS):
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), token_ids(part.column("text"), known)):
            packer.add(doc_id, ids)
            held += len(ids)
        if held >= TOKENS_AT_ONCE:
            packer.fill()
            held = 0
        yield from _rows(packer)
    packer.fill()
    packer.fill(last=True)
    yield from _rows(packer)


def _rows(packer: Packer) -> Iterator[pa.RecordBatch]:
    rows, packer.rows = packer.rows, []
    if rows:
        yield batch(arrow_schema(SCHEMA), *zip(*rows))


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text): its ids' place in the document and in its sequence."""
    return documents(docs).mapInArrow(lambda batches: _pack(batches, tokenizer_path), SCHEMA)
