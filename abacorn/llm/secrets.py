"""Secret scans: base patterns, and a character convolutional network in numpy over every other candidate and its surroundings.

Base findings (assign, access, hex) are leftmost non-overlapping matches of fixed patterns in the whole text, and stay whatever the network
says. Candidates are all runs of CANDIDATE's characters, less what base findings cover of them, of 16 or more with a digit and a letter, or of 20 or more
in mixed case. The network reads 24 characters before, the candidate (in pieces of 64, the best counts) and 8 after: embedding, convolution
of width 5, rectifier, maximum over the candidate and over the surroundings, logistic output. It is trained on labelled findings, a table
that rules build here from a fixed seed; of the third that is held back one half serves a logistic calibration and the other the threshold, the highest of
which a binomial test at level DOUBT says that it recalls RECALL of the secrets, but no higher than even odds. Candidates at or above it are findings of kind model. It is trained once, on the driver.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no finding. Rows are scanned one by one, repeated rows
alike; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from abacorn.llm.common import arrow_schema, batch, documents, slices

#: The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "model")
LEAST, CANDIDATE = 16, re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
BEFORE, PIECE, AFTER = 24, 64, 8
WIDTH, EMBED, FILTERS, KERNEL = BEFORE + PIECE + AFTER, 8, 24, 5
RECALL, DOUBT, SEED, EXAMPLES, EPOCHS = 0.98, 0.1, 7, 6000, 6
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, model_score double"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates outside the findings, which are sorted by start."""
    out, at, n, covered = [], 0, len(taken), 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < n and taken[at][0] < end:
            if taken[at][0] > max(start, covered):
                out += _candidate(text, max(start, covered), taken[at][0])
            covered = max(covered, taken[at][2])
            at += 1
        out += _candidate(text, max(start, covered), end)
    return out


def _candidate(text: str, start: int, end: int) -> list[tuple[int, int]]:
    if end - start < LEAST:
        return []
    run = text[start:end]
    letter, digit = any(c.isalpha() for c in run), any(c.isdigit() for c in run)
    mixed = len(run) >= 20 and sum(a.islower() and b.isupper() for a, b in zip(run, run[1:])) >= 3
    return [(start, end)] if letter and (digit or mixed) else []


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of each piece of a candidate with what surrounds it: printable ASCII, other characters, nothing."""
    out = []
    for low in range(start, end, PIECE):
        high = min(end, low + PIECE)
        before, inside, after = text[max(0, low - BEFORE) : low], text[low:high], text[high : high + AFTER]
        shown = before.rjust(BEFORE, "\0") + inside.ljust(PIECE, "\0") + after.ljust(AFTER, "\0")
        c = np.array([ord(x) for x in shown])
        out.append(np.where(c == 0, 0, np.where((c >= 32) & (c < 127), c - 30, 1)).astype(np.uint8))
    return out


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n texts with a candidate's place each, and whether it is a secret: keys and tokens of common shapes against look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 9)))
    number = lambda a, b: str(int(rng.integers(a, b)))
    secret = [
        lambda: pick(low + up + num, int(rng.integers(20, 48))), lambda: pick(low + up + num + "+/", int(rng.integers(24, 64))) + "==", lambda: "ghp_" + pick(low + up + num, 36),
        lambda: "sk_live_" + pick(low + up + num, 24), lambda: "xoxb-" + pick(num, 11) + "-" + pick(low + up + num, 24), lambda: "eyJ" + pick(low + up + num, 24) + ".eyJ" + pick(low + up + num + "_-", 40),
        lambda: "AIza" + pick(low + up + num + "_-", 35), lambda: pick(low + num, int(rng.integers(24, 40))), lambda: "glpat-" + pick(low + up + num + "_-", 20),
    ]
    plain = [
        lambda: f"{word()}.{word()}.{number(1, 99)}.example.com", lambda: f"{word()}-{word()}-{number(1900, 2100)}-{word()}.html", lambda: "/".join([word(), word(), number(1, 999), word() + ".txt"]),
        lambda: ".".join(number(10, 255) for _ in range(4)) + "." + word(), lambda: f"{word()}_{word()}_{word()}_{number(1, 999)}", lambda: f"{number(1990, 2040)}-{number(10, 12)}-{number(10, 28)}T{number(10, 23)}.00.00Z",
        lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())) + number(1, 9), lambda: word() + "=" * int(rng.integers(14, 30)) + number(1, 9), lambda: f"v{number(1, 20)}.{number(0, 20)}.{number(0, 20)}-{word()}-{word()}",
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 7)))) + number(1, 99), lambda: f"{word()}/{word()}/IMG_{number(20000101, 20301231)}_{number(100000, 235959)}.jpg",
        lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(3, 6)))) + f".{word()}{number(1, 9)}", lambda: f"{word().upper()}_{word().upper()}_{word().upper()}_{number(1, 9999)}",
        lambda: "-".join(word() for _ in range(4)) + number(1, 99), lambda: f"{word()}.{number(1, 99)}-{word()}.{word()}-mail{number(1, 9)}", lambda: number(10**14, 10**15) + word()[:1],
    ]
    hints = ['key: "', "auth = ", "Authorization: Bearer ", "export K=", "credentials ", "https://host/?sig="]
    out, y = [], np.array([int(i % 2 == 0) for i in range(n)])
    for kind in y:
        pool = secret if kind else plain
        run = ""
        while len(run) < 16:
            run = pool[int(rng.integers(len(pool)))]()
        before = " ".join(word() for _ in range(4)) + " " + (hints[int(rng.integers(len(hints)))] if rng.random() < (0.4 if kind else 0.1) else "")
        out.append((f"{before}{run} {word()} {word()}", len(before), len(before) + len(run)))
    return out, y


class Network:
    """The convolutional network; forward keeps what backward needs."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        size = lambda *shape: (rng.normal(size=shape) / np.sqrt(np.prod(shape[:-1]) or 1)).astype(np.float32)
        self.p = {"embed": size(97, EMBED) * 3, "conv": size(KERNEL * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "out": size(2 * FILTERS, 1), "base": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> np.ndarray:
        p, n = self.p, len(x)
        embedded = p["embed"][x] * (x > 0)[:, :, None]
        steps = WIDTH - KERNEL + 1
        unfolded = np.lib.stride_tricks.sliding_window_view(embedded, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, KERNEL * EMBED)
        active = np.maximum(0, unfolded @ p["conv"] + p["bias"])
        inside = np.zeros(steps, bool)
        inside[BEFORE : BEFORE + PIECE - KERNEL + 1] = True
        tops, at = [], []
        for where in (np.flatnonzero(inside), np.flatnonzero(~inside)):
            a = active[:, where].argmax(axis=1)
            at.append(where[a])
            tops.append(np.take_along_axis(active, at[-1][:, None, :], axis=1)[:, 0])
        pooled = np.concatenate(tops, axis=1)
        self.kept = (x, unfolded, pooled, at)
        return (pooled @ p["out"] + p["base"])[:, 0]

    def backward(self, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, unfolded, pooled, at) = self.p, self.kept
        n, g = len(x), {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["base"] = pooled.T @ slope[:, None], np.array([slope.sum()], np.float32)
        down = slope[:, None] * p["out"][:, 0] * (pooled > 0)
        for half, places in enumerate(at):
            d = down[:, half * FILTERS : (half + 1) * FILTERS]
            rows = unfolded[np.arange(n)[:, None], places]
            g["conv"] += np.einsum("nf,nfk->kf", d, rows)
            g["bias"] += d.sum(axis=0)
            back = (d[:, :, None] * p["conv"].T[None]).reshape(n, FILTERS, KERNEL, EMBED)
            for k in range(KERNEL):
                codes = x[np.arange(n)[:, None], places + k]
                np.add.at(g["embed"], codes, back[:, :, k] * (codes > 0)[:, :, None])
        return g

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(x) + self.shift, -40, 40)))


@functools.lru_cache(maxsize=2)
def trained(seed: int = SEED) -> Network:
    """The network fitted to the labelled findings, calibrated, with its threshold; for the driver to train and send."""
    texts, y = labelled_findings(EXAMPLES, seed)
    x = np.stack([windows(*t)[0] for t in texts])
    held = np.arange(len(x)) % 3 == 2
    net, rng, moments, step = Network(seed), np.random.default_rng(seed + 1), {}, 0
    rows = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for low in range(0, len(rows), 64):
            some = rows[low : low + 64]
            slope = (1 / (1 + np.exp(-np.clip(net.forward(x[some]), -40, 40))) - y[some]).astype(np.float32) / len(some)
            step += 1
            for k, g in net.backward(slope).items():
                m, v = moments.get(k, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[k] = m, v
                net.p[k] = (net.p[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    calibrating, deciding = np.flatnonzero(held)[: held.sum() // 2], np.flatnonzero(held)[held.sum() // 2 :]
    z, t = net.forward(x[calibrating]).astype(np.float64), y[calibrating]
    scale, shift = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -40, 40)))
        scale, shift = scale - 0.05 * float(((q - t) * z).mean()), shift - 0.5 * float((q - t).mean())
    net.scale, net.shift = scale, shift
    chances = np.sort(net.probability(x[deciding])[y[deciding] == 1])
    net.threshold = min(0.5, float(chances[misses(len(chances))]))
    net.kept = None
    return net


def misses(n: int) -> int:
    """The most misses among n secrets that a recall of RECALL or less would stay at or below with a chance of at most DOUBT; 0 if none are few enough."""
    chance = total = RECALL**n
    k = 0
    while True:
        chance *= (n - k) / (k + 1) * (1 - RECALL) / RECALL
        if total + chance > DOUBT:
            return k
        total, k = total + chance, k + 1


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_texts(texts: list, net: Network | None = None) -> list[tuple]:
    """For each text: counts of the base kinds, their digest, all spans, number of model findings, the best model score."""
    net, base, asked, codes = net or trained(), [], [], []
    for i, text in enumerate(texts):
        found = base_findings(text) if text else []
        base.append(found)
        for start, end in candidates(text, found) if text else []:
            pieces = windows(text, start, end)
            asked.append((i, start, end, len(codes), len(codes) + len(pieces)))
            codes += pieces
    chance = np.concatenate([net.probability(np.stack(codes[low : low + 512])) for low in range(0, len(codes), 512)]) if codes else np.zeros(0)
    more: list[list] = [[] for _ in texts]
    top = [0.0] * len(texts)
    for i, start, end, a, b in asked:
        best = float(chance[a:b].max())
        top[i] = max(top[i], best)
        if best >= net.threshold:
            more[i].append((start, 3, end))
    out = []
    for found, model, best in zip(base, more, top):
        n = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        out.append((*n, hashlib.sha256(joined(found).encode()).hexdigest(), joined(sorted(found + model)), len(model), best))
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): base counts and digest, all spans as kind:start:end, and the model's part."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch(arrow_schema(SCHEMA), part.column("doc_id"), *zip(*scan_texts(part.column("text").to_pylist(), sent.value)))

    return documents(docs).mapInArrow(run, SCHEMA)
