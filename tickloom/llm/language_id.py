"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors over hashed byte n-grams (two and three bytes, ASCII lower-cased). Each language
is described by several centroids, found by spherical k-means, because one mean would blur its registers. A text gets
the language of the centroid with the largest cosine; if even that one is farther away than the centroid's own training
texts are, the text is rejected. Short texts have small cosines whatever their language, so what is compared is the
cosine over the root of the number of different n-grams, up to FULL_GRAMS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import add_columns, fresh, packs, remainder, ship, unit_hash

ship(__name__)

BUCKETS = 4096
PER_LANGUAGE = 800  # about so many training texts per language; bounds the sample together with MAX_CHARS
MAX_CHARS = 20_000
CENTROIDS = 4
FOLDS = 5
LOW = 0.01  # quantile of the closeness of a centroid's own training texts
SLACK = 0.5  # a text is rejected below this share of that quantile
LEAST_GRAMS = 50  # training texts with fewer different n-grams do not count in the quantile
FULL_GRAMS = 400

# Letters in lower case and all bytes beyond ASCII stay; digits, marks and white space become a space.
LETTERS = bytes(b if 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray  # one row of unit length each
    names: list[str]  # the language of each centroid
    floors: np.ndarray  # least closeness that each centroid accepts


def gram_counts(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed two- and three-byte grams per text, over letters with one space between runs of them.

    Grams do not cross texts.
    """
    texts = len(starts) - 1
    low = np.frombuffer(data.tobytes().translate(LETTERS), np.uint8).astype(np.uint32)
    if len(low):
        kept = low != 32
        kept[1:] |= kept[:-1]
        heads = starts[:-1][np.diff(starts) > 0]
        kept[heads] = low[heads] != 32  # whatever letter the text before it ends with
        low = low[kept]
        before = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        starts = before[starts].astype(np.int64)
    total = np.zeros(texts * buckets + 1, dtype=np.int64)
    if len(low) < 2:
        return total[:-1].reshape(texts, buckets).astype(np.float32)
    base = np.repeat(np.arange(texts, dtype=np.int64) * buckets, np.diff(starts))
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    ends = starts[1:]
    mixed = low * np.uint32(0x9E3779B1)
    mixed = mixed[:-1] ^ (low[1:] * np.uint32(0x85EBCA77))
    for order in (2, 3):
        if order == 3:
            mixed = (mixed[:-1] * np.uint32(0x27D4EB2F)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
        place = base[:len(mixed)] + ((mixed * np.uint32(0x2C1B3C6D)) >> shift)
        for back in range(1, order):
            over = ends - back
            place[over[(over >= 0) & (over < len(place))]] = texts * buckets
        total += np.bincount(place, minlength=len(total))
    return total[:-1].reshape(texts, buckets).astype(np.float32)


def counted(column: pa.Array) -> np.ndarray:
    """One row of counts per text of a small column."""
    return np.vstack([sum(gram_counts(d, s) for d, s in parts) for _, _, parts in packs(column)])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def closeness(cosines: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Cosines of texts with so many different n-grams, made comparable between short and long texts."""
    return cosines / np.sqrt(np.clip(grams, 1, FULL_GRAMS))


def _floors(near: np.ndarray, grams: np.ndarray, nearest: np.ndarray, count: int, slack: float) -> list[float]:
    """A floor per centroid of a language; one without long enough texts takes that of all texts of the language."""
    fits = grams >= LEAST_GRAMS if (grams >= LEAST_GRAMS).any() else grams >= 0
    parts = [fits & (nearest == k) for k in range(count)]
    return [slack * float(np.quantile(near[p if p.any() else fits], LOW)) for p in parts]


def _clusters(vectors: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the first centres are texts at even steps of closeness to the mean, so outliers start none."""
    mean = vectors.mean(axis=0)
    order = np.argsort(vectors @ mean, kind="stable")
    count = min(count, len(vectors))
    centres = vectors[order[((np.arange(count) + 0.5) * len(vectors) / count).astype(int)]] + mean
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([vectors[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(count)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(vectors @ centres.T, axis=1)


def fit_centroids(texts: list[str], langs: list[str], centroids: int = CENTROIDS, slack: float = SLACK) -> LanguageModel:
    """Centroids, IDF weights and rejection floors from a sample of texts with their languages."""
    if not texts:
        return LanguageModel(np.ones(BUCKETS, np.float32), np.empty((0, BUCKETS), np.float32), [], np.empty(0))
    counts = counted(pa.array(texts, pa.string()))
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors, names = weighted(counts, idf), np.array(langs, dtype=object)
    grams = (counts > 0).sum(axis=1)
    centres, owners, floors = [], [], []
    for lang in sorted(set(langs)):
        own = vectors[names == lang]
        found, nearest = _clusters(own, centroids)
        near = closeness(np.max(own @ found.T, axis=1), grams[names == lang])
        centres.extend(found)
        owners.extend([lang] * len(found))
        floors.extend(_floors(near, grams[names == lang], nearest, len(found), slack))
    return LanguageModel(idf, np.stack(centres).astype(np.float32), owners, np.array(floors))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, folds: int = FOLDS) -> DataFrame:
    """About ``per_language`` texts of each language, by a hash of the id; the held-out fold is never among them."""
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars) & (remainder("doc_id", folds) != 0)
    )
    counts = docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", folds) != 0)).groupBy("lang").count().collect()
    chance = F.lit(0.0)
    for row in counts:  # one entry per language, the classes of the model
        chance = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, per_language / row["count"]))).otherwise(chance)
    return usable.filter(unit_hash("doc_id", seed=5) < chance).groupBy("doc_id").agg(
        F.min(F.struct("lang", "text")).alias("row")
    ).select("doc_id", "row.lang", "row.text")


def fit(docs: DataFrame, **parameters: int) -> LanguageModel:
    """Learn from the ``lang`` of documents outside the held-out fold; an empty table gives a model without languages."""
    rows = sorted(training_rows(docs, **parameters).collect(), key=lambda r: r["doc_id"])
    return fit_centroids([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``, from the text alone.

    A null text, an empty one or one without a letter gets ``und``, 0 and true; so does every text if the model has
    seen no language, but it is not rejected then. Equal cosines go to the centroid that comes first by language.
    Repeated rows get equal results; other columns pass through, and a new column whose name they have gets underscores
    in front.
    """
    letters = fresh(docs, "__letters")
    marked = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [(f"{prefix}lang_at", T.IntegerType()), (f"{prefix}lang_score", T.DoubleType()), (f"{prefix}lang_far", T.BooleanType())]

    def compute(column: pa.Array) -> list[pa.Array]:
        at, score, far = np.full(len(column), -1, np.int32), np.zeros(len(column)), np.zeros(len(column), bool)
        if model.names:
            for first, end, parts in packs(column):
                counts = sum(gram_counts(d, s) for d, s in parts)
                cosines = weighted(counts, model.idf) @ model.centroids.T
                best = np.argmax(cosines, axis=1)
                at[first:end], score[first:end] = best, np.clip(cosines[np.arange(end - first), best], 0, 1)
                near = closeness(score[first:end], (counts > 0).sum(axis=1))
                far[first:end] = (near < model.floors[best]) | (near <= 0)
        return [pa.array(at, pa.int32()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]

    place, near, far = (fresh(marked, n) for n, _ in fields)
    made = add_columns(marked, text, list(zip((place, near, far), (kind for _, kind in fields))), compute)
    known = F.col(letters) & (F.col(place) >= 0)
    names = F.array(*[F.lit(n) for n in model.names]) if model.names else F.array(F.lit("und"))
    kept = [F.col(c) for c in docs.columns]
    return made.select(
        *kept,
        F.when(known, F.get(names, F.col(place))).otherwise("und").alias(fresh(docs, f"{prefix}lang_pred")),
        F.when(known, F.col(near)).otherwise(F.lit(0.0)).alias(fresh(docs, f"{prefix}score")),
        (~F.col(letters) | F.coalesce(F.col(far), F.lit(False))).alias(fresh(docs, f"{prefix}rejected")),
    )


__all__ = ["LanguageModel", "closeness", "counted", "fit", "fit_centroids", "gram_counts", "identify", "training_rows", "weighted"]
