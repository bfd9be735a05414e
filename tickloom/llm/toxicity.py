"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each step of the network reads one word: a vector for the word joined with the mean vector of its character n-grams
(three to five bytes with marks for both ends), so that unseen words with known parts count too. A text is read in
overlapping windows, every one of them is scored, and the text has the score of its worst window. Only documents are
labelled, not windows, so training alternates: the worst windows of toxic documents serve as toxic examples for the next
round, windows of clean documents as clean ones; the first guess goes by log odds of words and n-grams. A final logistic step turns a document's worst logit into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import add_columns, fresh, kept_in_worker, labelled_sample, remainder, ship

ship(__name__)

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WINDOW, STRIDE = 32, 24  # words
PER_CLASS = (5000, 1500)  # bound of the training sample: clean and toxic documents
MAX_CHARS = 6000
WORDS, GRAMS = 1 << 13, 1 << 14  # hashed rows of word vectors and of n-gram vectors
DIMENSIONS = 8  # of either
HIDDEN = 8  # per direction
ATTENTION = 8
CACHED_WORDS = 150_000
TRAIN_BLOCK = 1 << 13  # words, or windows, whose arrays training makes at a time: they would outgrow the sample many times
TEXT_WORDS = 1 << 16  # a longer text is read in stretches of so many words, which overlap like windows


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Parts:
    """Hashed pieces of distinct words: a word row each, and n-gram rows with the word they belong to, in order of words."""

    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    count: np.ndarray


def word_parts(words: list[str]) -> Parts:
    bare = [(w.strip(".,;:!?\"'()") or w).encode("utf-8", "replace") for w in words]
    row = np.fromiter((zlib.crc32(b) % WORDS for b in bare), np.int64, len(bare))
    data = np.frombuffer(b"".join(b"<" + b + b">" for b in bare), np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(b) + 2 for b in bare), np.int64, len(bare))
    of = np.repeat(np.arange(len(bare), dtype=np.int32), lengths)
    grams, owners = [], []
    mixed = data * np.uint32(0x9E3779B1)
    for n in range(2, 6):
        mixed = (mixed[:-1] * np.uint32(0x85EBCA77)) ^ (data[n - 1:] * np.uint32(0xC2B2AE3D))
        if n >= 3 and len(mixed):
            inside = of[:len(mixed)] == of[n - 1:]
            grams.append(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(18))[inside].astype(np.int32))
            owners.append(of[:len(mixed)][inside])
    gram = np.concatenate(grams) if grams else np.empty(0, np.int32)
    owner = np.concatenate(owners) if owners else np.empty(0, np.int32)
    order = np.argsort(owner, kind="stable")  # three sorted runs to merge
    gram, owner = gram[order], owner[order]
    return Parts(row, gram, owner, np.maximum(np.bincount(owner, minlength=len(bare)), 1).astype(np.float32))


def summed(values: np.ndarray, to: np.ndarray, rows: int) -> np.ndarray:
    """Rows of ``values`` added up by ``to``."""
    width = values.shape[1]
    place = (to[:, None] * width + np.arange(width)).ravel()
    return np.bincount(place, weights=values.ravel(), minlength=rows * width).reshape(rows, width).astype(np.float32)


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = 2 * DIMENSIONS

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    made = {
        "word": normal(WORDS, DIMENSIONS, scale=0.02), "gram": normal(GRAMS, DIMENSIONS, scale=0.02),
        "attend": normal(2 * HIDDEN, ATTENTION, scale=0.3), "attend_bias": np.zeros(ATTENTION, np.float32),
        "query": normal(ATTENTION, scale=0.5), "out": normal(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
    }
    for way in ("forward", "backward"):
        made |= {
            f"{way}_in": normal(size, 3 * HIDDEN, scale=size ** -0.5), f"{way}_bias": np.zeros(3 * HIDDEN, np.float32),
            f"{way}_state": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5), f"{way}_new": np.zeros(HIDDEN, np.float32),
        }
    return made


def word_vectors(weights: dict[str, np.ndarray], parts: Parts) -> np.ndarray:
    characters = np.zeros((len(parts.word), DIMENSIONS), np.float32)
    if len(parts.owner):
        first = np.flatnonzero(np.diff(parts.owner, prepend=-1))
        characters[parts.owner[first]] = np.add.reduceat(weights["gram"][parts.gram], first, axis=0)
    characters /= parts.count[:, None]
    return np.hstack([weights["word"][parts.word], characters])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _read(weights: dict[str, np.ndarray], way: str, inputs: np.ndarray, mask: np.ndarray, kept: list | None) -> np.ndarray:
    """States (steps, windows, hidden) of one direction; ``inputs`` (steps, windows, 3 hidden) already projected."""
    state, new_bias = weights[f"{way}_state"], weights[f"{way}_new"]
    steps, windows = mask.shape
    h = np.zeros((windows, HIDDEN), np.float32)
    out = np.empty((steps, windows, HIDDEN), np.float32)
    for t in range(steps) if way == "forward" else range(steps - 1, -1, -1):
        through = h @ state
        gates = _sigmoid(inputs[t, :, :2 * HIDDEN] + through[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        carried = through[:, 2 * HIDDEN:] + new_bias
        n = np.tanh(inputs[t, :, 2 * HIDDEN:] + r * carried)
        step = mask[t][:, None] * (1 - z)
        if kept is not None:
            kept.append((t, h, z, r, carried, n))
        h = h + step * (n - h)
        out[t] = h
    return out


def forward(weights: dict[str, np.ndarray], table: np.ndarray, index: np.ndarray, lengths: np.ndarray,
            kept: dict | None = None) -> np.ndarray:
    """Logits of windows; ``index`` (windows, steps) points into ``table``, the projected distinct words.

    A window without words has an empty pool: its logit is the bias.
    """
    steps = index.shape[1]
    mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
    inputs = table[index.T]
    caches = ([], []) if kept is not None else (None, None)
    states = np.concatenate([
        _read(weights, "forward", inputs[:, :, :3 * HIDDEN], mask, caches[0]),
        _read(weights, "backward", inputs[:, :, 3 * HIDDEN:], mask, caches[1]),
    ], axis=2)
    seen = np.tanh(states @ weights["attend"] + weights["attend_bias"])
    power = np.where(mask > 0, np.exp(np.clip(seen @ weights["query"], -30, 30)), np.float32(0))
    share = power / np.maximum(power.sum(axis=0), 1e-30)
    pooled = np.einsum("tb,tbh->bh", share, states)
    if kept is not None:
        kept.update(mask=mask, states=states, seen=seen, share=share, pooled=pooled, caches=caches)
    return pooled @ weights["out"] + weights["out_bias"][0]


def projected(weights: dict[str, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors @ weights[f"{way}_in"] + weights[f"{way}_bias"] for way in ("forward", "backward")])


def _unread(weights: dict[str, np.ndarray], way: str, cache: list, mask: np.ndarray, slope: np.ndarray, to: dict) -> np.ndarray:
    """Back through one direction: slopes of its projected inputs; those of its weights go into ``to``."""
    state = weights[f"{way}_state"]
    inputs = np.empty((*mask.shape, 3 * HIDDEN), np.float32)
    later = np.zeros_like(slope[0])
    for t, before, z, r, carried, n in reversed(cache):
        whole = later + slope[t]
        m = mask[t][:, None]
        own = whole * m
        d_new = own * (1 - z) * (1 - n * n)
        d_carried = d_new * r
        d_z = own * (before - n) * z * (1 - z)
        d_r = d_new * carried * r * (1 - r)
        inputs[t] = np.hstack([d_z, d_r, d_new])
        through = np.hstack([d_z, d_r, d_carried])
        to[f"{way}_state"] += before.T @ through
        to[f"{way}_new"] += d_carried.sum(axis=0)
        later = own * z + whole * (1 - m) + through @ state.T
    return inputs


def slopes(weights: dict[str, np.ndarray], parts: Parts, index: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean logistic loss of windows over the distinct words in ``parts``."""
    vectors = word_vectors(weights, parts)
    kept: dict = {}
    logit = forward(weights, projected(weights, vectors), index, lengths, kept)
    to = {k: np.zeros_like(v) for k, v in weights.items()}
    error = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    states, seen, share = kept["states"], kept["seen"], kept["share"]
    to["out"], to["out_bias"] = kept["pooled"].T @ error, np.array([error.sum()], np.float32)
    pooled = error[:, None] * weights["out"]
    grown = np.einsum("bh,tbh->tb", pooled, states)
    energy = share * (grown - (share * grown).sum(axis=0))
    to["query"] = np.einsum("tb,tba->a", energy, seen)
    inner = energy[:, :, None] * weights["query"] * (1 - seen * seen)
    to["attend"] = np.einsum("tbh,tba->ha", states, inner, optimize=True)
    to["attend_bias"] = inner.sum(axis=(0, 1))
    back = share[:, :, None] * pooled + inner @ weights["attend"].T
    rows = index.T.ravel()
    word = np.zeros_like(vectors)
    for way, cache, part in (("forward", kept["caches"][0], back[:, :, :HIDDEN]), ("backward", kept["caches"][1], back[:, :, HIDDEN:])):
        inputs = _unread(weights, way, cache, kept["mask"], part, to).reshape(-1, 3 * HIDDEN)
        by_word = summed(inputs, rows, len(vectors))
        to[f"{way}_in"], to[f"{way}_bias"] = vectors.T @ by_word, by_word.sum(axis=0)
        word += by_word @ weights[f"{way}_in"].T
    to["word"] = summed(word[:, :DIMENSIONS], parts.word, WORDS)
    to["gram"] = summed((word[:, DIMENSIONS:] / parts.count[:, None])[parts.owner], parts.gram, GRAMS)
    return to


def windows(length: int) -> list[tuple[int, int]]:
    """Starts and ends of overlapping windows that cover ``length`` words; one empty window for none."""
    last = max(0, -(-(length - WINDOW) // STRIDE))
    return [(k * STRIDE, min(k * STRIDE + WINDOW, length)) for k in range(last + 1)]


def cut(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of sequences of word numbers: (windows, WINDOW) numbers, their lengths, and the sequence of each."""
    size = np.array([len(s) for s in sequences], np.int64)
    count = np.maximum(-(-(size - WINDOW) // STRIDE), 0) + 1
    of = np.repeat(np.arange(len(size)), count)
    within = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    lengths = np.minimum(size[of] - within, WINDOW)
    joined = np.concatenate([*sequences, np.zeros(WINDOW, np.int32)]).astype(np.int32)
    begins = (np.cumsum(size) - size)[of] + within
    return joined[begins[:, None] + np.arange(WINDOW)] if len(begins) else np.empty((0, WINDOW), np.int32), lengths, of


class Tables:
    """Projected inputs of distinct words, one contiguous array per direction and gate."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights, self.rows = weights, 0
        self.gates = [np.zeros((1024, HIDDEN), np.float32) for _ in range(6)]
        # Gates of both directions side by side; half of the logistic ones' input, for logistic(x) = (tanh(x / 2) + 1) / 2.
        scale = (0.5, 0.5, 1.0)
        self.states = [
            np.stack([weights[f"{way}_state"][:, g * HIDDEN:(g + 1) * HIDDEN] * scale[g] for way in ("forward", "backward")]).astype(np.float32)
            for g in range(3)
        ]
        self.new = np.stack([weights[f"{way}_new"] for way in ("forward", "backward")])[:, None, :].astype(np.float32)
        self.scale = scale

    def add(self, vectors: np.ndarray) -> None:
        values = projected(self.weights, vectors)
        end = self.rows + len(values)
        for k in range(6):
            if end > len(self.gates[k]):
                grown = np.zeros((max(2 * len(self.gates[k]), end), HIDDEN), np.float32)
                grown[:self.rows] = self.gates[k][:self.rows]
                self.gates[k] = grown
            self.gates[k][self.rows:end] = values[:, k * HIDDEN:(k + 1) * HIDDEN] * np.float32(self.scale[k % 3])
        self.rows = end


def _logits(tables: Tables, index: np.ndarray, lengths: np.ndarray, full: bool) -> np.ndarray:
    """As ``forward``, both directions at once and step by step in a few small arrays that stay in the cache."""
    weights, (steps, count) = tables.weights, index.shape
    h = np.zeros((2, count, HIDDEN), np.float32)
    x, through = [np.empty_like(h) for _ in range(3)], [np.empty_like(h) for _ in range(3)]
    states = np.empty((steps, count, 2 * HIDDEN), np.float32)
    half, mask = np.float32(0.5), None
    for t in range(steps):
        for way, at in ((0, t), (1, steps - 1 - t)):
            for g in range(3):
                np.take(tables.gates[3 * way + g], index[at], axis=0, out=x[g][way], mode="clip")
        for g in range(3):
            np.matmul(h, tables.states[g], out=through[g])
        z, r, n = x
        for gate, own in ((z, through[0]), (r, through[1])):
            gate += own
            np.tanh(gate, out=gate)
            gate += np.float32(1)
            gate *= half
        through[2] += tables.new
        through[2] *= r
        n += through[2]
        np.tanh(n, out=n)
        if not full:
            mask = (lengths > np.array([[t], [steps - 1 - t]])).astype(np.float32)[:, :, None]
            z *= mask
            z += 1 - mask
        h -= n
        h *= z
        h += n
        states[t, :, :HIDDEN] = h[0]
        states[steps - 1 - t, :, HIDDEN:] = h[1]
    seen = states.reshape(-1, 2 * HIDDEN) @ weights["attend"]
    seen += weights["attend_bias"]
    np.tanh(seen, out=seen)
    power = np.exp(np.clip(seen @ weights["query"], -30, 30)).reshape(steps, count)
    if not full:
        power *= np.arange(steps)[:, None] < lengths
    # The pool is only needed through the output weights.
    value = (states.reshape(-1, 2 * HIDDEN) @ weights["out"]).reshape(steps, count)
    return (power * value).sum(axis=0) / np.maximum(power.sum(axis=0), 1e-30) + weights["out_bias"][0]


def score_windows(tables: Tables, index: np.ndarray, lengths: np.ndarray, block: int = 256) -> np.ndarray:
    """Logits of any number of windows in blocks of similar length."""
    out = np.empty(len(lengths), np.float32)
    order = np.argsort(lengths, kind="stable")
    for a in range(0, len(order), block):
        rows = order[a:a + block]
        own = lengths[rows]
        steps = max(1, int(own[-1]))
        out[rows] = _logits(tables, np.ascontiguousarray(index[rows, :steps].T), own, bool(own[0] == steps))
    return out


def worst(logits: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    best = np.full(texts, -np.inf, np.float32)
    np.maximum.at(best, of, logits)
    return best


@dataclass
class ToxicityModel:
    weights: dict[str, np.ndarray]
    slope: float  # of the document's worst logit
    shift: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * logits.astype(float) + self.shift)))


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (a * logits + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - labels) * logits).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.1 * b])
        h = np.array([[(w * logits * logits).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - da, 0.05), b - db
    return float(a), float(b)


def _log_odds(sequences: list[np.ndarray], labels: np.ndarray, parts_of: Callable[[np.ndarray], Parts], prior: float = 4.0) -> dict[str, np.ndarray]:
    """For each hashed row of words and n-grams the log of how much more often toxic documents have it than clean ones.

    A few documents' worth of chance (``prior``) is added, so rows of rare words stay near 0.
    """
    counts = {"word": np.zeros((2, WORDS)), "gram": np.zeros((2, GRAMS))}
    for words, label in zip(sequences, labels):
        if len(words):
            parts = parts_of(np.unique(words))
            counts["word"][int(label), np.unique(parts.word)] += 1
            counts["gram"][int(label), np.unique(parts.gram)] += 1
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])[:, None]
    size = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rates = {k: (c + prior * share) / (size + prior * share) for k, c in counts.items()}
    return {k: np.log(r[1] / r[0]).astype(np.float32) for k, r in rates.items()}


def _joined_parts(words: list[str], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, n-gram rows, and where the n-grams of each word start and end, made from a block of words at a time."""
    word, gram, size = [], [], []
    for a in range(0, len(words), block):
        parts = word_parts(words[a:a + block])
        word.append(parts.word)
        gram.append(parts.gram)
        size.append(np.bincount(parts.owner, minlength=len(parts.word)))
    return np.concatenate(word), np.concatenate(gram), np.concatenate([[0], np.cumsum(np.concatenate(size))])


def train(texts: list[str], labels: np.ndarray, rounds: int = 5, steps: int = 140, batch: int = 192, rate: float = 0.01, seed: int = 11) -> ToxicityModel:
    """Learn from documents with labels 0 and 1. Without both classes every text gets the share of toxic ones (0.0 for none)."""
    labels = np.asarray(labels, float)
    weights = start_weights()
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(weights, 0.0, 20.0 if len(labels) and labels.max() else -20.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    sequences = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    words = list(vocabulary) or [""]
    del vocabulary
    index, lengths, of = cut(sequences)
    toxic = labels[of] > 0
    count, block = len(words), TRAIN_BLOCK
    word, gram, bounds = _joined_parts(words, block)
    del words

    def parts_of(rows: np.ndarray) -> Parts:
        size = bounds[rows + 1] - bounds[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Parts(word[rows], gram[place], owner, np.maximum(size, 1).astype(np.float32))

    def blocks() -> Iterator[Parts]:
        for a in range(0, count, block):
            yield parts_of(np.arange(a, min(a + block, count)))

    odds = _log_odds(sequences, labels, parts_of)
    for name, start in odds.items():
        weights[name][:, 0] += np.float32(0.5) * start
    # The first guess at the window that makes a document toxic is the one with the most telling words.
    telling = np.maximum(np.concatenate([
        odds["word"][p.word] + np.bincount(p.owner, odds["gram"][p.gram], minlength=len(p.word)) / p.count for p in blocks()
    ]), 0)
    spoken = np.concatenate([
        np.where(np.arange(WINDOW) < lengths[a:a + block, None], telling[index[a:a + block]], 0).sum(axis=1).astype(np.float32)
        for a in range(0, len(index), block)
    ])
    best = worst(spoken, of, len(labels))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    bad, clean, hard = np.flatnonzero(toxic & (spoken >= best[of])), np.flatnonzero(~toxic), np.flatnonzero(~toxic)
    step = 0
    for turn in range(rounds):
        for _ in range(steps):
            step += 1
            third = batch // 3
            rows = np.concatenate([rng.choice(bad, third), rng.choice(hard, third), rng.choice(clean, third)])
            found, local = np.unique(index[rows], return_inverse=True)
            change = slopes(weights, parts_of(found), local.reshape(len(rows), WINDOW), lengths[rows], toxic[rows].astype(np.float32))
            pace = rate * (0.3 if turn == rounds - 1 else 1)
            for k, d in change.items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                weights[k] -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        tables = Tables(weights)
        for parts in blocks():
            tables.add(word_vectors(weights, parts))
        logits = score_windows(tables, index, lengths)
        top = worst(logits, of, len(labels))
        bad = np.flatnonzero(toxic & (logits >= np.minimum(top[of], 2.0)))  # the worst of each text, and any that is plainly bad
        hard = clean[np.argsort(-logits[clean], kind="stable")[:max(200, len(clean) // 50)]]
    return ToxicityModel(weights, *_calibrated(top.astype(float), labels))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, per_class: tuple[int, int] = PER_CLASS,
        max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold; the sample is bounded by the parameters."""
    allowed = F.coalesce(remainder("doc_id", folds) != held_out, F.lit(False))
    rows = sorted(labelled_sample(docs, labels, "toxic", allowed, per_class, max_chars).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], np.array([r["y"] for r in rows]))


class Scorer:
    """Scores whole texts; keeps the projected vectors of words it has met, up to a bound."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known, self.tables = {}, Tables(self.model.weights)

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            for w in new:
                known[w] = len(known)
            self.tables.add(word_vectors(self.model.weights, word_parts(new)))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self._forget()
        logits = np.full(len(texts), -np.inf, np.float32)
        waiting, of, held = [], [], 0
        for k, text in enumerate(texts):
            words = words_of(text)
            for a in range(0, max(len(words) - (WINDOW - STRIDE), 1), TEXT_WORDS):
                waiting.append(words[a:a + TEXT_WORDS + WINDOW - STRIDE])
                of.append(k)
                held += len(waiting[-1])
            if held > TEXT_WORDS:
                self._flush(waiting, of, logits)
                waiting, of, held = [], [], 0
        self._flush(waiting, of, logits)
        return self.model.probability(logits)

    def _flush(self, waiting: list[list[str]], of: list[int], logits: np.ndarray) -> None:
        if not waiting:
            return
        flat = self.numbers([w for words in waiting for w in words])
        edges = np.cumsum([0, *[len(words) for words in waiting]])
        index, lengths, window_of = cut([flat[a:b] for a, b in zip(edges, edges[1:])])
        found = score_windows(self.tables, index, lengths)
        np.maximum.at(logits, np.array(of)[window_of], found)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with the probability of being toxic, that of the worst of all overlapping windows of the whole text.

    Null and empty texts have one window without words. Repeated rows get equal scores; other columns pass through
    (``name`` gets underscores in front if it is taken).
    """
    key = zlib.crc32(b"".join(np.ascontiguousarray(w).tobytes() for w in model.weights.values()), int(1e6 * model.shift) & 0xFFFFFFFF)

    def compute(column: pa.Array) -> list[pa.Array]:
        scorer = kept_in_worker(("toxicity", key), lambda: Scorer(model))
        return [pa.array(scorer([t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]), pa.float64())]

    return add_columns(docs, text, [(fresh(docs, name), T.DoubleType())], compute)
