"""Language identification, vector search and the whole pipeline, each against a plain version that takes one row at a time."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_exact import RANKS, fingerprint, groups_by_force

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import language_id, quality_rules, queries, toxicity, vector_search
from tickloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"
WORD = 1 << 32


def grams(text):
    """Counts of hashed pairs and triples of bytes, one by one."""
    low, counts = [], np.zeros(language_id.BUCKETS)
    last = 32
    for b in (text or "").encode():
        letter = language_id.LETTERS[b]
        if letter != 32 or last != 32:
            low.append(letter)
        last = letter
    for a, b in zip(low, low[1:]):
        counts[(((a * 0x9E3779B1) % WORD ^ (b * 0x85EBCA77) % WORD) * 0x2C1B3C6D) % WORD >> 20] += 1
    for a, b, c in zip(low, low[1:], low[2:]):
        two = ((a * 0x9E3779B1) % WORD ^ (b * 0x85EBCA77) % WORD) * 0x27D4EB2F % WORD
        counts[((two ^ (c * 0xC2B2AE3D) % WORD) * 0x2C1B3C6D) % WORD >> 20] += 1
    return counts


def language(model, text):
    """(language, score, rejected)"""
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0, True
    counts = grams(text)
    vector = np.log1p(counts) * model.idf
    cosines = model.centroids @ (vector / max(np.linalg.norm(vector), 1e-12))
    best = int(np.argmax(cosines))
    near = cosines[best] / np.sqrt(min(max((counts > 0).sum(), 1), language_id.FULL_GRAMS))
    return model.names[best], float(np.clip(cosines[best], 0, 1)), bool(near < model.floors[best] or near <= 0)


def test_language_query(spark):
    docs = table(spark, FOLDER, "documents")
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = entry.queries()["op5_language_id"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        name, score, rejected = language(model, texts[r["doc_id"]])
        assert (r["lang_pred"], r["rejected"]) == (name, rejected) and r["score"] == pytest.approx(score, abs=1e-5)


def test_spaces_in_front_do_not_depend_on_the_text_before(spark):
    docs = table(spark, FOLDER, "documents")
    model = language_id.fit(docs)
    rows = spark.createDataFrame([("  the one of them",), ("the other",), ("  the one of them",), ("?",), ("  the one of them",)], "text string").coalesce(1)
    assert len({r["score"] for r in language_id.identify(rows, model).collect() if r["text"].startswith("  ")}) == 1


def test_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "some words that stay here", 0.5, "mine", True, 7)], "doc_id long, text string, Score double, lang_pred string, kept boolean, n_words int")
    judged = quality_rules.judge(docs, docs.select("doc_id"))
    assert judged.columns == [*docs.columns, "_n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_score", "base_failed", "_kept"]
    row = judged.collect()[0]
    assert (row["n_words"], row["_n_words"], row["kept"], row["_kept"], row["Score"]) == (7, 5, True, False, 0.5)
    model = language_id.fit(table(spark, FOLDER, "documents"))
    found = language_id.identify(docs.withColumn("rejected", F.lit("mine")), model)
    assert found.columns == [*docs.columns, "rejected", "_lang_pred", "_score", "_rejected"]
    assert found.collect()[0]["lang_pred"] == "mine"


def neighbours(ids, v, every=20, k=20):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        best = {}
        for own in v[ids == q]:
            for i, s in zip(ids.tolist(), v @ own):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_vector_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchnumpy()
    ids, v = rows["vec_id"], np.stack(rows["embedding"]).astype(float)
    want = neighbours(ids, v)
    found = {}
    for r in entry.queries()["op4_vector_search"](spark, folder).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(found) == sorted(want) and all(len(f) == 20 for f in found.values())
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97


def test_clustered_vectors_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    v = np.round(centres[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 16)), 2)
    v[1000:1300] = v[1000]  # copies, whose ties go to the smaller id
    ids = np.arange(4000)
    ids[2000:2050] = 2001  # one id many times
    rows = [(int(i), x) for i, x in zip(ids, v.tolist())] + [(20 * k, [1.0, 2.0]) for k in range(1000, 1100)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = neighbours(ids, v)
    found = {}
    for r in vector_search.nearest(vectors, list_rows=16, block=700).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == sorted(want)
    hits = 0
    for q, best in want.items():
        got = [found[q][k] for k in range(1, 21)]
        assert len({i for i, _ in got}) == 20 and got == sorted(got, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in got} & {i for i, _ in best})
    assert hits >= 0.97 * 20 * len(want)


def test_graph_finds_the_lists(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30_000, 32))
    length = float(np.sqrt((v * v).sum(axis=1).max()))
    centroids = vector_search.balanced_centroids(vector_search.lifted(v, length), 600)
    index = vector_search.Index(centroids, *vector_search.graph_of(centroids), length)
    asked = vector_search.as_queries(v[:200], length)
    dist = np.linalg.norm(asked[:, None] - centroids[None], axis=2)
    want = dist <= vector_search.RATIO * dist.min(axis=1, keepdims=True)
    found = vector_search.searched_lists(index, asked)
    assert (found & want).sum() >= 0.98 * want.sum() and (found & ~want).sum() <= 0.01 * want.sum()


def test_pipeline_by_force(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = toxicity.Scorer(toxicity.fit(docs, labels))([r["text"] or "" for r in rows.values()])
    rows = {d: r for (d, r), s in zip(rows.items(), scores) if s < toxicity.THRESHOLD}
    left = docs.filter(F.col("doc_id").isin(list(rows)))
    model = language_id.fit(left)
    rows = {d: r for d, r in rows.items() if not language(model, r["text"])[2]}
    prints = {d: fingerprint(r["text"]) for d, r in rows.items()}
    root, first = groups_by_force(set(prints.values())), {}
    for d in sorted(rows):
        first.setdefault(root[prints[d]], d)
    rows = {d: rows[d] for d in first.values()}
    documents = pd.DataFrame([r.asDict() for r in rows.values()])  # noqa: F841  (read by name below)
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for d, size, taken in duckdb.sql(f"SELECT doc_id, size, taken FROM ({queries.MIXING_SQL})").fetchall():
        want += [(d, coder.encode_ordinary(rows[d]["text"] or ""))] * (taken // max(size, 1))
    found = entry.queries()["pipeline"](spark, FOLDER).collect()
    assert len(corpus_pipeline.STAGES) == 5 and len(want) > 10

    def digest(pairs):
        return sorted((d, hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in pairs)

    assert digest((r["doc_id"], r["ids"]) for r in found) == digest(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
