"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are documents labelled as good; everything else is unlabelled web text, a mixture of good and bad.
The class prior (the share of good text in the mixture) is estimated, then a small network minimises the non-negative
unbiased risk: prior * loss(positives) + max(0, loss(unlabelled as negative) - prior * loss(positives as negative)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import PIECE_BYTES, add_columns, fresh, labelled_sample, packs, remainder, ship, unit_hash

ship(__name__)

FOLDS = 5
POSITIVES = 5000  # bound of the trusted sample
UNLABELLED = 10_000  # about so many unlabelled texts
MAX_CHARS = 50_000
THRESHOLD = 0.3

# Classes of bytes: letters, digits, white space, sentence marks, brackets, markup, the rest, and bytes beyond ASCII.
CLASS = np.full(256, 7, np.int64)
CLASS[128:] = 8
for _number, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:!?'\"-", b"#*$%&|<>")):
    CLASS[list(_members)] = _number
CLASSES = 9
CLASS_OF = CLASS.astype(np.uint8).tobytes()
COUNTS = 6  # words, words like the one before, distinct words, lines with text, distinct lines, bytes
WIDTH = CLASSES * CLASSES + CLASSES + COUNTS
POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 257, dtype=np.uint64)).astype(np.uint64)


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run ends where a text begins."""
    before = np.concatenate([[False], inside[:-1]])
    before[first] = False
    after = np.concatenate([inside[1:], [False]])
    after[first[first > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    picked = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    spread = picked * POWERS[place & 255] + (place >> 8).astype(np.uint64)
    summed = np.add.reduceat(spread, np.cumsum(lengths) - lengths) if len(lengths) else spread
    return summed ^ (lengths.astype(np.uint64) << np.uint64(40))


def _distinct(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """How many different hashes each text has."""
    if not len(hashes):
        return np.zeros(texts)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed)
    ordered, of = mixed[order], owner[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.bincount(of[new], minlength=texts).astype(float)


def sums(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts per text; for one that comes in several parts see :func:`long_sums`."""
    texts = len(starts) - 1
    out = np.zeros((texts, WIDTH))
    if not len(data):
        return out
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(texts), lengths)
    kind = np.frombuffer(data.tobytes().translate(CLASS_OF), np.uint8).astype(np.int64)
    out[:, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=texts * CLASSES).reshape(texts, CLASSES)
    pair = owner[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:]
    same = owner[:-1] == owner[1:]
    out[:, CLASSES:CLASSES + CLASSES * CLASSES] = np.bincount(pair[same], minlength=texts * CLASSES * CLASSES).reshape(texts, -1)
    first = starts[:-1][lengths > 0]
    begins, ends = _runs((kind != 3) & (kind != 4), first)
    hashes, of = _hashes(data, begins, ends), owner[begins]
    again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    line_begins, line_ends = _runs(data != 10, first)
    line_of = owner[line_begins]
    rest = out[:, -COUNTS:]
    rest[:, 0] = np.bincount(of, minlength=texts)
    rest[:, 1] = np.bincount(of[1:][again], minlength=texts)
    rest[:, 2] = _distinct(of, hashes, texts)
    rest[:, 3] = np.bincount(line_of, minlength=texts)
    rest[:, 4] = _distinct(line_of, _hashes(data, line_begins, line_ends), texts)
    rest[:, 5] = lengths
    return out


def _whole(parts: list[np.ndarray], ends: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of a text, cut only after the bytes that ``ends`` marks."""
    held = []
    for part in parts:
        at = np.flatnonzero(ends[part])
        cut = at[-1] + 1 if len(at) else 0
        if cut:
            yield np.concatenate([*held, part[:cut]])
            held = []
        held.append(part[cut:])
    yield np.concatenate(held)


def _counts_of_spans(parts: list[np.ndarray], ends: np.ndarray) -> tuple[int, int, int]:
    """Spans between the bytes that ``ends`` marks: how many, how many like the one before, how many different ones."""
    count, again, last, seen, room = 0, 0, None, [], 1 << 20
    for data in _whole(parts, ends):
        inside = ~ends[data]
        if not inside.any():
            continue
        begins, stops = _runs(inside, np.zeros(1, np.int64))
        hashes, long = np.empty(len(begins), np.uint64), stops - begins > PIECE_BYTES
        hashes[~long] = _hashes(data, begins[~long], stops[~long])
        for k in np.flatnonzero(long):
            hashes[k] = int.from_bytes(hashlib.blake2b(data[begins[k]:stops[k]].tobytes(), digest_size=8).digest(), "little")
        count += len(hashes)
        again += int((hashes[1:] == hashes[:-1]).sum()) + int(last is not None and hashes[0] == last)
        last = hashes[-1]
        seen.append(np.unique(hashes))
        if sum(map(len, seen)) > room:
            seen = [np.unique(np.concatenate(seen))]
            room = 2 * len(seen[0]) + (1 << 20)
    return count, again, len(np.unique(np.concatenate(seen))) if seen else 0


def long_sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Counts of one text that comes in several parts: words and lines across them count as they would in one."""
    out, pieces = sum(sums(d, s) for d, s in parts), [d for d, _ in parts if len(d)]
    for a, b in zip(pieces, pieces[1:]):
        out[0, CLASSES + CLASS[a[-1]] * CLASSES + CLASS[b[0]]] += 1
    out[0, -COUNTS:-COUNTS + 3] = _counts_of_spans(pieces, (CLASS == 3) | (CLASS == 4))
    lines, _, own = _counts_of_spans(pieces, np.arange(256) == 10)
    out[0, -COUNTS + 3:-COUNTS + 5] = lines, own
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Shares of the counts, independent of the length of a text but for one column."""
    words, again, distinct, lines, own_lines, size = (counts[:, -COUNTS + k] for k in range(COUNTS))
    shares = np.sqrt(counts[:, :-COUNTS] / np.maximum(size, 1)[:, None])
    some = np.maximum(words, 1)
    more = [again / some, distinct / some, np.log1p(words), np.log1p(size / some), np.log1p(words / np.maximum(lines, 1)), own_lines / np.maximum(lines, 1)]
    return np.column_stack([shares, *more]).astype(np.float32)


def text_features(column: pa.Array) -> np.ndarray:
    return np.vstack([features(sums(*parts[0]) if len(parts) == 1 else long_sums(parts)) for _, _, parts in packs(column)])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return _forward(self.weights, np.clip((rows - self.mean) / self.scale, -6, 6))[0]


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden @ weights[2] + weights[3], hidden


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 1500, batch: int = 256,
          rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> list[np.ndarray]:
    """Weights that minimise the non-negative unbiased risk with the logistic loss, by Adam.

    When the negative part of the risk falls below zero, the step goes up its gradient instead, so that the network
    does not learn the unlabelled positives by heart.
    """
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    weights = [rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        p, u = positive[rng.integers(len(positive), size=batch)], unlabelled[rng.integers(len(unlabelled), size=batch)]
        x = np.vstack([p, u])
        g, h = _forward(weights, x)
        share = sigmoid(g)
        softplus = np.logaddexp(0, g)
        negative = softplus[batch:].mean() - prior * softplus[:batch].mean()
        slope = np.zeros(2 * batch)
        if negative >= 0:
            slope[:batch] = (prior * (share[:batch] - 1) - prior * share[:batch]) / batch
            slope[batch:] = share[batch:] / batch
        else:
            slope[:batch] = prior * share[:batch] / batch
            slope[batch:] = -share[batch:] / batch
        back = slope[:, None] * weights[2] * (1 - h * h)
        slopes = [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
        for w, d, (m, v) in zip(weights, slopes, moments):
            d = d + decay * w
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return weights


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Share of positives in the unlabelled scores: the smallest U(A) / P(A) over sets A of high scores.

    On any set the mixture holds at least prior * P(A), and a set without negatives reaches that; sets with less than
    ``least`` of the positives are left out as too noisy.
    """
    positive = np.sort(positive)
    cuts = positive[:int(len(positive) * (1 - least)) + 1]
    have = 1 - np.arange(len(cuts)) / len(positive)
    mixed = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    return float(np.clip((mixed / have).min(), 0.05, 0.99))


def fit_features(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Standardise, estimate the prior with a first network on one half, then train by the risk above.

    Without positives or without unlabelled texts the model answers 0.5 to everything.
    """
    width = WIDTH
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((rows - mean) / scale, -6, 6) for rows in (positive, unlabelled))
    # Positives against the mixture itself (prior 0.5 keeps both terms equal); the other half measures the shares.
    first = train(p[::2], u[::2], 0.5, steps=500)
    half_p, half_u = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    prior = estimate_prior(_forward(first, half_p)[0], _forward(first, half_u)[0])
    return QualityModel(mean, scale, train(p, u, prior), prior)


def _sampled_features(rows: DataFrame) -> np.ndarray:
    made = add_columns(rows.select("doc_id", "text"), "text", [("features", T.ArrayType(T.FloatType()))],
                       lambda column: [pa.array(list(text_features(column)), pa.list_(pa.float32()))])
    found = sorted(made.select("doc_id", "features").collect(), key=lambda r: r["doc_id"])
    return np.array([r["features"] for r in found], np.float32).reshape(len(found), WIDTH)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        max_chars: int = MAX_CHARS) -> QualityModel:
    """Learn from documents outside the held-out fold: those labelled 1 as positives, any of them as unlabelled.

    Both samples are bounded by the parameters and picked by a hash of the id.
    """
    allowed = F.coalesce(remainder("doc_id", folds) != 0, F.lit(False))
    trusted = labelled_sample(docs, labels, "quality", allowed, (0, positives), max_chars)
    usable = docs.select("doc_id", "text").filter(allowed & (F.length("text") <= max_chars))
    total = docs.filter(allowed).count()
    mixed = usable.filter(unit_hash("doc_id", seed=2) < min(1.0, unlabelled / max(total, 1)))
    mixed = mixed.groupBy("doc_id").agg(F.min("text").alias("text"))
    return fit_features(_sampled_features(trusted), _sampled_features(mixed))


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality, computed from the whole text alone.

    Null and empty texts have all counts zero and get the score of that point. Repeated rows get equal scores; other
    columns, whatever their names, pass through (``name`` gets underscores in front if it is taken).
    """
    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.array(sigmoid(model.logits(text_features(column))).astype(float), pa.float64())]

    return add_columns(docs, text, [(fresh(docs, name), T.DoubleType())], compute)
