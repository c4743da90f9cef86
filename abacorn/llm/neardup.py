"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact check of links, connected classes.

Two texts are near-duplicates if the weighted Jaccard similarity of their word 5-grams (weight: occurrences) is 0.8 or more.

Equal texts, by 128 bits of hashes, are one node, and nodes have numbers of their own. Keys with many rows (a band of a large group, a text of many
copies, the root of a large class) are salted wherever rows are joined by them.

Defined cases: a text without a word (null, empty, white space, punctuation) belongs to no group, so it is a class of its own and
its class id is its own doc_id. A text of one to four words has one shingle of all its words. Rows with equal text are one node
whatever their doc_id, and rows of one doc_id with different texts are as many nodes; the class id is the smallest non-null doc_id of the class,
null if there is none. Every row of the input gives one row of the result, repeated rows included. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import arrow_schema, batch, broadcast_if_small, documents, hot_keys, join_salted, materialise, mix64, release, slices, text_hashes, word_codes

SHINGLE, SIMILARITY = 5, 0.8
#: 16 bands of 4 coordinates: a pair of similarity 0.8 misses all of them with probability 0.0002.
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
#: Rounds of stars before what is left of the buckets is compared in blocks; shingle occurrences of a block.
STARS, BLOCK = 3, 1_000_000
#: Edges of the rank cells below 1; above 1 a cell is one wide.
SMALL_CELLS = [0.0, *(2.0**-e for e in range(6, 0, -1))]
WORD = re.compile(r"\w+")


def _poisson_table() -> dict[float, np.ndarray]:
    """Cumulative Poisson probabilities, as 53-bit thresholds, by the area of a cell."""
    areas = {b - a for a, b in zip(SMALL_CELLS, [*SMALL_CELLS[1:], 1.0])} | {1.0}
    out = {}
    for area in areas:
        terms = np.cumprod([np.exp(-area), *(area / j for j in range(1, 24))])
        out[area] = np.cumsum(terms)
    return out


POISSON = _poisson_table()


def dart_signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash of n weighted sets: uint64 [n, k], rank of the earliest dart of a coordinate above and its mark below.

    owner, hashes, weights: an entry for each element of each set. The region of an element is its weight times the rank axis; unit
    layers of weight and cells of rank are seeded by (element, layer, cell) and hold Poisson many darts. Darts above the weight
    don't count. A set looks at ranks up to (k ln k + 2 k) / its weight, and on until every coordinate has a dart; for the earliest
    darts alone count, two sets share a coordinate with probability equal to their weighted Jaccard similarity.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, k), full, dtype=np.uint64)
    if not len(owner):
        return out
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    who, part = owner[at], np.minimum(1.0, weights[at] - layer)
    seed = mix64(hashes[at] ^ mix64(layer.astype(np.uint64) + np.uint64(1)))
    total = np.bincount(owner, weights=weights, minlength=n)
    need = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    open_ = total > 0
    cell, flat = 0, out.reshape(-1)
    while True:
        low = SMALL_CELLS[cell] if cell < len(SMALL_CELLS) else float(cell - len(SMALL_CELLS) + 1)
        high = (SMALL_CELLS[cell + 1] if cell + 1 < len(SMALL_CELLS) else 1.0) if cell < len(SMALL_CELLS) else low + 1.0
        late = open_ & (need <= low)
        if late.any():
            rows = np.flatnonzero(late)
            open_[rows[(out[rows] != full).all(axis=1)]] = False
            keep = open_[who]
            who, part, seed = who[keep], part[keep], seed[keep]
        if not len(who):
            return out
        draw = mix64(seed ^ mix64(np.uint64(0xD1B54A32D192ED03) + np.uint64(cell)))
        chance = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        table = POISSON[high - low]
        hit = np.flatnonzero(chance >= table[0])
        darts = np.searchsorted(table, chance[hit], side="right")
        rows = np.repeat(hit, darts)
        number = np.arange(len(rows)) - np.repeat(np.cumsum(darts) - darts, darts)
        mark = mix64(draw[rows] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more = mix64(mark)
        inside = (more >> np.uint64(40)).astype(np.float64) * 2.0**-24 < part[rows]
        rows, mark, more = rows[inside], mark[inside], more[inside]
        rank = low + (high - low) * ((mark >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        value = (np.minimum(rank * 2.0**24, 2.0**32 - 1).astype(np.uint64) << np.uint64(32)) | (mark & np.uint64(0xFFFFFFFF))
        coordinate = (more & np.uint64(0xFFFFFF)).astype(np.int64) % k
        np.minimum.at(flat, who[rows].astype(np.int64) * k + coordinate, value)
        cell += 1


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, occurrences) of the distinct word 5-grams of each text."""
    words, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = WORD.findall(text.lower())
            counts[i] = len(found)
            words += found
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    codes, distinct = word_codes(words)
    hashed = text_hashes(distinct)[codes]
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - SHINGLE + 1, counts > 0))
    per = np.maximum(counts - SHINGLE + 1, counts > 0).astype(np.int64)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + starts[owner]
    end = (starts + counts)[owner]
    value = np.full(len(owner), 0x5EED, dtype=np.uint64)
    for step in range(SHINGLE):
        there = position + step < end
        value = mix64(value ^ np.where(there, hashed[np.minimum(position + step, len(hashed) - 1)], np.uint64(7)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return owner[at], value[at], np.diff([*at, len(owner)]).astype(np.float64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """int64 [n, BANDS]: a key for each band of each signature."""
    n = len(signatures)
    parts = signatures.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(11)), (n, BANDS))
    for r in range(ROWS):
        key = mix64(key ^ parts[:, :, r])
    return key.astype(np.int64)


SIGNED, UNITS = "doc_id long, h1 long, h2 long, bands array<long>", "node long, units array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        owner, value, weight = shingles(part.column("text").to_pylist())
        some = np.unique(owner)
        compact = np.searchsorted(some, owner)
        signatures = dart_signatures(compact, value, weight, len(some))
        keys = band_keys(signatures)
        bands = [None] * part.num_rows
        for j, i in enumerate(some):
            bands[i] = keys[j]
        yield batch(arrow_schema(SIGNED), part.column("doc_id"), part.column("h1"), part.column("h2"), bands)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each occurrence of each shingle as one number, so that the overlap of two arrays is the weighted intersection."""
    for part in slices(batches):
        owner, value, weight = shingles(part.column("text").to_pylist())
        times = weight.astype(np.int64)
        at = np.repeat(np.arange(len(owner)), times)
        layer = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        units, who = mix64(value[at] ^ mix64(layer.astype(np.uint64))).astype(np.int64), owner[at]
        edges = np.searchsorted(who, np.arange(part.num_rows + 1))
        yield batch(arrow_schema(UNITS), part.column("node"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(units)))


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the parts of one pair of blocks: enough to join all parts that a near pair joins, one row for each join.

    Units are ranked by how few members hold them. Near members share one of the first fifth of their units (and one more), so postings of those
    alone name the pairs to look at; each is checked on all units before it joins anything, and members of one part need no look.
    """
    frame = frame.drop_duplicates("node").reset_index(drop=True)
    node = frame["node"].to_numpy()
    _, part = np.unique(frame["root"].to_numpy(), return_inverse=True)
    sizes = np.array([len(x) for x in frame["units"]])
    _, flat, holders = np.unique(np.concatenate(frame["units"].to_list()), return_inverse=True, return_counts=True)
    rank = np.empty(len(holders), dtype=np.int64)
    rank[np.argsort(holders, kind="stable")] = np.arange(len(holders))
    flat, owner = rank[flat], np.repeat(np.arange(len(sizes)), sizes)
    flat = flat[np.lexsort((flat, owner))]
    starts = np.cumsum(sizes) - sizes
    prefix = (sizes * (1 - SIMILARITY) + 1e-9).astype(np.int64) + 1
    first = np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(prefix, sizes)
    held, who = flat[first], owner[first]
    order = np.argsort(held, kind="stable")
    held, who = held[order], who[order]
    a, b = [], []
    for i in range(len(node)):
        mine = flat[starts[i] : starts[i] + sizes[i]]
        low, high = np.searchsorted(held, mine[: prefix[i]], "left"), np.searchsorted(held, mine[: prefix[i]], "right")
        near = np.unique(np.concatenate([who[x:y] for x, y in zip(low, high)]))
        for j in near[near < i]:
            if part[j] == part[i] or min(sizes[i], sizes[j]) < SIMILARITY * max(sizes[i], sizes[j]) - 1e-9:
                continue
            both = len(np.intersect1d(mine, flat[starts[j] : starts[j] + sizes[j]], assume_unique=True))
            if both >= SIMILARITY * (sizes[i] + sizes[j] - both) - 1e-9:
                a.append(node[i])
                b.append(node[j])
                part[part == part[j]] = part[i]
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _exact(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) of weighted Jaccard similarity SIMILARITY or more; pairs is materialised, and an elected b may be in many of them."""
    side = lambda c: units.select(F.col("node").alias(c), F.col("units").alias(f"u{c}"))
    both = F.size(F.array_intersect("ua", "ub"))
    near = both >= SIMILARITY * (F.size("ua") + F.size("ub") - both) - 1e-9
    return join_salted(pairs, side("b"), ["b"]).join(side("a"), "a").where(near).select("a", "b")


def _links(nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Joins (a, b) of different texts: enough of them to join all texts that a near pair in a bucket joins, each by the exact check or through its part's root.

    In a round every bucket of a band elects one member, the smallest under a mask of the bucket's and the round's own, and every other
    member that isn't joined with it yet is checked against it exactly: rows grow with the members, not their square. Buckets whose
    members are all joined are done. What is left after the last round is compared in pairs of blocks, again exactly, and a block
    returns a row for each join that it makes, at most one less than it has members.
    """
    members = materialise(nodes.select("node", F.explode("bands").alias("band")), "members")
    several = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    rows = materialise(join_salted(members, several, ["band"]), "bands")
    wanted = materialise(rows.select("node").distinct().join(nodes.select("node", "h1", "h2", "rep"), "node"), "wanted")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) if c == "rep" else F.col(f"d.{c}") == F.col(f"w.{c}") for c in ("h1", "h2", "rep")]
    texts = docs.withColumnRenamed("doc_id", "rep").alias("d").join(broadcast_if_small(wanted).alias("w"), same).select("w.node", "d.text")
    units = texts.mapInArrow(_units, UNITS)
    units = materialise(units.dropDuplicates(["node"]) if repeated else units, "units")
    release(members, wanted)
    rooted, joined, links = rows.withColumn("root", F.col("node")), None, None
    for turn in range(STARS):
        mask = F.xxhash64("band", F.lit(turn))
        chosen = rooted.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("least")).select("band", F.col("least").bitwiseXOR(mask).alias("node"))
        chosen = chosen.join(rooted, ["band", "node"]).select("band", F.col("node").alias("leader"), F.col("root").alias("leading"))
        # one try for each part that a member meets; what that misses is left to the next rounds and the blocks
        met = join_salted(rows, chosen, ["band"], hot=hot_keys(rows, "band")) if turn == 0 else join_salted(rooted, chosen, ["band"])
        met = met.withColumn("root", F.col("node")) if turn == 0 else met
        pairs = met.where("root != leading").groupBy(F.col("node").alias("a"), "leading").agg(F.min("leader").alias("b")).select("a", "b")
        pairs = materialise(pairs, "pairs")
        good = materialise(_exact(pairs, units), "good")
        before, joined = joined, components(good if links is None else links.union(good))
        links = joined.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))  # a row for each node, not for each link
        left = _unsettled(rows if turn == 0 else rooted.drop("root"), joined)
        release(pairs, good, before, rows if turn == 0 else rooted)
        rooted = left
        if rooted.isEmpty():
            release(units, rooted)
            return links
    sized = units.select("node", F.size("units").cast("long").alias("size"))
    sized = materialise(rooted.join(sized, "node"), "sized")
    totals = sized.groupBy("band").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    rows = join_salted(sized, totals, ["band"]).withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "root", F.xxhash64("band").alias("bucket"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(units, "node")
    found = materialise(rows.groupBy("bucket", "low", "high").applyInPandas(_compare, "a long, b long").distinct(), "found")
    release(sized, rooted, units)
    return links.union(found)


def _unsettled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, band, root) of the buckets that still hold several parts."""
    rooted = materialise(rows.join(found, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root")), "rooted")
    bands = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    out = materialise(join_salted(rooted, bands, ["band"]).select("node", "band", "root"), "unsettled")
    release(rooted)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link: labels fall to the smallest neighbour's and jump to their label's label."""
    edges = materialise(links.union(links.select("b", "a")).where("a != b").distinct(), "edges")
    hubs = hot_keys(edges, "b")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        near = join_salted(edges, labels.withColumnRenamed("node", "b"), ["b"], hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        fallen = materialise(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "least").alias("root")), "fallen")
        jumped = join_salted(fallen, labels.select(F.col("node").alias("root"), F.col("root").alias("beyond")), ["root"], "left")
        following = materialise(jumped.select("node", "was", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        release(labels, fallen)
        labels = following
        if following.where("was != root").isEmpty():
            release(edges)
            return labels.select("node", "root")


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with h1 and h2, 128 bits that stand for the text."""
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text, h1, h2): signed, a row each; classes, (h1, h2, node, rep, root, class_id) of every text with a word; repeated, the
    (h1, h2, doc_id) that several rows have. All are materialised."""
    signed = materialise(docs.mapInArrow(_sign, SIGNED), "signed")
    worded = signed.where(F.col("bands").isNotNull())
    texts = worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    # the place in the task above the task's number, so that a mask picks members evenly
    place, task = F.shiftleft(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 32) - 1)), 31), F.spark_partition_id().cast("long")
    nodes = materialise(texts.withColumn("node", place.bitwiseOR(task)), "nodes")
    repeated = materialise(worded.groupBy("h1", "h2", "doc_id").count().where("count > 1").select("h1", "h2", "doc_id"), "repeated")
    links = _links(nodes, docs, not repeated.isEmpty())
    rooted = nodes.select("node", "h1", "h2", "rep").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = materialise(join_salted(rooted, least, ["root"]), "classes")
    release(nodes, rooted)
    return signed, classes, repeated


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, is_kept (whether doc_id is its class's id)."""
    signed, classes, _ = _classes(_hashed(documents(docs)))
    alone = F.col("bands").isNull()
    out = join_salted(signed, classes.select("h1", "h2", "class_id"), ["h1", "h2"], "left")
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs, with one row of each class and every row without a word.

    A class keeps a row of its smallest non-null doc_id (of none, if it has none); where that id has several texts of the class, or several rows
    of the text, one of them.
    """
    narrow = _hashed(documents(docs))
    signed, classes, repeated = _classes(narrow)
    chosen = classes.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("node").alias("node"))
    kept = classes.join(chosen, ["root", "node"]).select("h1", "h2", "rep", F.lit(True).alias("worded"))
    alone = signed.where(F.col("bands").isNull()).select("h1", "h2").distinct().select("h1", "h2", F.lit(None).cast("long").alias("rep"), F.lit(False).alias("worded"))
    kept = materialise(kept.union(alone), "kept")
    release(signed, classes)
    h1, h2, key = "__abacorn_h1", "__abacorn_h2", "__abacorn_id"
    text = F.col("text").cast("string")
    rows = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text), key: F.col("doc_id").cast("long")})

    def matching(right: DataFrame, whole: bool) -> Column:
        same = F.col(key).eqNullSafe(right["rep" if whole else "doc_id"])
        return (F.col(h1) == right["h1"]) & (F.col(h2) == right["h2"]) & ((same | ~right["worded"]) if whole else same)

    small = broadcast_if_small(kept)
    out = rows.join(small, matching(small, True), "left_semi")
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated)
        out = out.join(again, matching(again, False), "left_anti").unionByName(out.join(again, matching(again, False), "left_semi").dropDuplicates([h1, h2]))
    return out.select(*docs.columns)
