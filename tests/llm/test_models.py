"""Operators that learn: held-out accuracy on the given tables, and odd rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language_id, quality_classifier, toxicity
from tickloom.llm.common import packs, table

FOLDER = "/root/testdata/sf0.1"
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, `TEXT_HASH` string"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def toxic_model(tables):
    return toxicity.fit(*tables)


@pytest.fixture(scope="module")
def quality_model(tables):
    return quality_classifier.fit(*tables)


def odd_rows(spark):
    long = "plain words of no harm " * 60_000
    rows = [(1, None, "en", None, None, 1.0, "x"), (2, "", "en", "s", 0, None, None), (None, "words without an id", None, "s", 1, None, None),
            (4, long, "en", "s", 1, 0.5, "y"), (4, long, "en", "s", 1, 0.5, "y"), (5, "12 34 ++", "en", "s", 1, 0.5, "y"), (6, "\n \t", "en", "s", 1, 0.5, "y")]
    return spark.createDataFrame(rows, ODD)


def test_toxic_documents_are_found(tables, toxic_model):
    docs, labels = tables
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    rows = toxicity.score(held, toxic_model).collect()
    bad, good = [r["toxic_score"] for r in rows if r["toxic"]], [r["toxic_score"] for r in rows if not r["toxic"]]
    assert np.mean(np.array(bad) >= toxicity.THRESHOLD) >= 0.85
    assert np.mean(np.array(good) >= toxicity.THRESHOLD) <= 0.03


def test_quality_of_held_out_documents(tables, quality_model):
    docs, labels = tables
    held = docs.join(labels.select("doc_id", "quality"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = quality_classifier.score(held, quality_model).collect()
    right = [(r["quality_score"] >= quality_classifier.THRESHOLD) == bool(r["quality"]) for r in rows]
    assert np.mean(right) >= 0.95
    assert 0.5 < quality_model.prior < 0.99


def test_language_of_held_out_documents(tables):
    docs, _ = tables
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = language_id.identify(held, language_id.fit(docs)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert np.mean([r["rejected"] for r in rows]) <= 0.02


def test_gibberish_and_unlearned_languages_are_rejected(spark, tables):
    docs, _ = tables
    held = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike(r"\p{L}"))
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(1000)]
    codes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(60)]
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
    far = [" ".join(words[:300]), " ".join(words), " ".join(words[:30]), " ".join(codes), finnish, finnish * 9]
    # One odd training text changes nothing for its language.
    odd = spark.createDataFrame([(10**9 + k, lang, "Q") for k in range(9) for lang in ("de", "en", "es", "fr")], "doc_id long, lang string, text string")
    for model in (language_id.fit(docs), language_id.fit(docs.select("doc_id", "lang", "text").unionByName(odd))):
        rows = language_id.identify(spark.createDataFrame([(t,) for t in far], "text string"), model).collect()
        assert [r["rejected"] for r in rows] == [True] * len(far)
        kept = language_id.identify(held, model).collect()
        assert np.mean([r["rejected"] for r in kept]) <= 0.002


def test_odd_rows_are_scored(spark, tables, toxic_model, quality_model):
    docs = odd_rows(spark)
    for found, name in ((toxicity.score(docs, toxic_model), "toxic_score"), (quality_classifier.score(docs, quality_model), "quality_score")):
        rows = found.collect()
        assert len(rows) == 7 and all(0 <= r[name] <= 1 for r in rows)
        assert rows[0][name] == rows[1][name] and rows[3][name] == rows[4][name]
    rows = language_id.identify(docs, language_id.fit(tables[0]), prefix="l_").collect()
    assert [r["l_lang_pred"] == "und" for r in rows] == [True, True, False, False, False, True, True]
    assert [r["l_rejected"] for r in rows][:2] == [True, True] and rows[0]["l_score"] == 0
    taken = docs.withColumn("toxic_score", F.lit("mine"))
    assert toxicity.score(taken, toxic_model).columns == [*taken.columns, "_toxic_score"]


def test_empty_tables(spark, tables):
    docs, labels = (t.limit(0) for t in tables)
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert quality_classifier.score(docs, quality_classifier.fit(docs, labels)).count() == 0
    assert language_id.identify(docs, language_id.fit(docs)).count() == 0
    some = tables[0].limit(3)
    assert {r["toxic_score"] < 0.01 for r in toxicity.score(some, toxicity.fit(some, labels)).collect()} == {True}
    assert {r["lang_pred"] for r in language_id.identify(some, language_id.fit(docs)).collect()} == {"und"}


def test_slopes_agree_with_differences():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float32) for k, v in toxicity.start_weights().items()}
    parts = toxicity.word_parts(["one", "two", "threes", "x"])
    index, lengths, label = rng.integers(0, 4, (5, 6)), np.array([6, 3, 1, 6, 4]), np.array([1, 0, 1, 0, 1], np.float32)
    found = toxicity.slopes(weights, parts, index, lengths, label)

    def loss():
        logit = toxicity.forward(weights, toxicity.projected(weights, toxicity.word_vectors(weights, parts)), index, lengths).astype(float)
        return float(np.mean(np.logaddexp(0, logit) - label * logit))

    for name, value in weights.items():
        at = np.unravel_index(np.argmax(np.abs(found[name])), value.shape)
        old, step = value[at], np.float32(3e-2)
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert found[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), name


def test_quick_inference_equals_the_trained_form():
    rng = np.random.default_rng(1)
    weights = toxicity.start_weights()
    vectors = toxicity.word_vectors(weights, toxicity.word_parts([f"w{k}" for k in range(50)]))
    tables = toxicity.Tables(weights)
    tables.add(vectors)
    sequences = [rng.integers(0, 50, n) for n in (0, 1, 31, 32, 33, 56, 57, 300)]
    index, lengths, of = toxicity.cut(sequences)
    want = toxicity.forward(weights, toxicity.projected(weights, vectors), index, lengths)
    assert np.allclose(toxicity.score_windows(tables, index, lengths, block=3), want, atol=1e-4)
    assert [len(toxicity.windows(len(s))) for s in sequences] == np.bincount(of).tolist()
    for s, count in zip(sequences, np.bincount(of)):
        covered = {k for a, b in toxicity.windows(len(s)) for k in range(a, b)}
        assert covered == set(range(len(s)))


def test_long_texts_score_as_their_windows():
    model = toxicity.train(["good day to you"] * 20 + ["you total moron"] * 20, np.array([0] * 20 + [1] * 20), rounds=2, steps=30)
    text = "good day to you " * 3000 + "you total moron " + "good day to you " * 3000
    whole = toxicity.Scorer(model)([text, "good day to you", ""])
    old, toxicity.TEXT_WORDS = toxicity.TEXT_WORDS, 7 * toxicity.STRIDE
    try:
        assert np.allclose(toxicity.Scorer(model)([text, "good day to you", ""]), whole, atol=1e-4)
    finally:
        toxicity.TEXT_WORDS = old
    assert whole[0] > 0.7 > whole[1]


def test_prior_estimate():
    rng = np.random.default_rng(2)
    positive, mixed = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)])
    assert quality_classifier.estimate_prior(positive, mixed) == pytest.approx(0.6, abs=0.06)


def test_words_and_lines_of_long_texts_count_once():
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 40)) for _ in range(300)]
    long_line = "x" * 150_000
    for text in ("\n".join(lines * 4), "\n".join([*lines, long_line, lines[0], long_line, long_line]), "no " * 60_000, "\n" * 140_000):
        column = pa.array([text], pa.string())
        (_, _, parts), = packs(column)
        assert len(parts) > 1
        data = np.frombuffer(text.encode(), np.uint8)
        assert np.array_equal(quality_classifier.long_sums(parts), quality_classifier.sums(data, np.array([0, len(data)])))


def test_training_takes_little_more_than_its_sample():
    rng = random.Random(4)
    texts = ["".join(f"{rng.randrange(1 << 50):x} " for _ in range(400)) for _ in range(300)]  # every word is new
    labels = np.array([k % 3 == 0 for k in range(300)], float)
    tracemalloc.start()
    try:
        model = toxicity.train(texts, labels, rounds=1, steps=2)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    old, toxicity.TRAIN_BLOCK = toxicity.TRAIN_BLOCK, 1 << 30
    try:
        whole = toxicity.train(texts, labels, rounds=1, steps=2)
    finally:
        toxicity.TRAIN_BLOCK = old
    assert all(np.array_equal(model.weights[k], whole.weights[k]) for k in whole.weights)
    assert np.allclose([model.slope, model.shift], [whole.slope, whole.shift], rtol=1e-4, atol=1e-4)
