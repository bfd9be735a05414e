"""Operators with exact results, against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import oracle
import pytest
import tiktoken
import xxhash
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tickloom.llm import bpe, mixing, quality_rules, simhash
from tickloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int, bits string"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "ONE TWO"), (None, "one two"), (None, base[0]), (7, base[0]), (7, base[0]),
            (8, base[0] + " tail"), (9, "é 中文 x " * 40), (10, base[1] + "\n" + base[1]), (11, base[2] * 400), (12, "a" * 50_000), (13, base[3]), (13, base[4])]
    rows += [(100 + k, base[5]) for k in range(40)]
    out = [(i, t, "en", [None, "a", "b", "c"][k % 4], 0, "clash", k, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, COLUMNS)


def fingerprint(text):
    words = [w.encode() for w in words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    grams = [b" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints, distance=4):
    """Class of each fingerprint by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if bin(a ^ b).count("1") <= distance:
                root[find(b)] = find(a)
    return {p: find(p) for p in values}


@pytest.mark.parametrize("limit", [simhash.GROUP_ROWS, 3])
def test_simhash_on_odd_rows(spark, limit):
    docs = odd_rows(spark)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    root = groups_by_force({p for _, p in rows})
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], math.inf))
    found = simhash.near_duplicates(docs, limit=limit).collect()
    have = sorted((r["doc_id"] or -1, r["bits"] & (1 << 64) - 1, r["component_id"] or -1) for r in found)
    assert have == sorted((d or -1, p, least.get(root[p], -1)) for d, p in rows)


def test_one_document_of_each_group_stays(spark):
    docs = odd_rows(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [r.asDict() for r in docs.collect()]
    root = groups_by_force({fingerprint(r["text"]) for r in rows})
    have = [root[fingerprint(r["text"])] for r in kept.collect()]
    assert sorted(have) == sorted(set(root.values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0
    for r in kept.collect():
        same = [x["doc_id"] for x in rows if root[fingerprint(x["text"])] == root[fingerprint(r["text"])] and x["doc_id"] is not None]
        assert r["doc_id"] == min(same, default=None)


def test_simhash_query(spark):
    found = {r["doc_id"]: r for r in entry.queries()["op6_simhash"](spark, FOLDER).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    prints = {d: fingerprint(t) for d, t in texts}
    root = groups_by_force(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    assert {d: (f"{p:016x}", least[root[p]]) for d, p in prints.items()} == {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()}


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(1200)], np.uint64)
    bits = np.unique(np.concatenate([centres[rng.integers(0, 40, 1200)] ^ noise, np.array([0, (1 << 64) - 1], np.uint64)]))
    group = rng.integers(0, 3, len(bits))
    order = np.lexsort((simhash.gray_rank(bits), group))
    group, bits = group[order], bits[order]
    index = simhash.GrayIndex(group, bits)
    have = {(int(a), int(b)) for x, y in index.links(0, len(bits), 4) for a, b in zip(x, y)}
    gap = np.bitwise_count(bits[:, None] ^ bits[None, :])
    want = {(int(a), int(b)) for a, b in np.argwhere((gap <= 4) & (group[:, None] == group[None, :])) if a < b}
    assert have == want and len(want) > 100


def test_components_of_chains_hubs_and_loops(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rule_counts(text):
    words, text = words_of(text), text or ""
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 5000 else None
    if twice is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        twice = {w for w, n in seen.items() if n > 1}
    covered = {j for k, w in enumerate(windows) if w in twice for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_rules_on_odd_rows_and_query(spark):
    docs = odd_rows(spark)
    trusted = spark.createDataFrame([(7,), (7,), (None,), (13,)], "doc_id long")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality_rules.judge(docs, trusted, prefix="q_").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[f"q_{n}"] for n in names) == rule_counts(r["text"])
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()
    found = entry.queries()["op1_quality_rules"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    buckets = buckets_of(spark, FOLDER)
    raw, target = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    good = {d for (d,) in labels}
    for d, grams in buckets.items():
        np.add.at(raw, grams, 1)
        if d in good:
            np.add.at(target, grams, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in found:
        assert tuple(r[n] for n in names) == rule_counts(texts[r["doc_id"]])
        score = ratio[buckets[r["doc_id"]]].mean() if len(buckets[r["doc_id"]]) else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def buckets_of(spark, folder):
    """Buckets of words and word pairs, hashed one by one."""
    out = {}
    for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        ones = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
        # Spark hashes several values by feeding each hash to the next as its seed.
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(ones, ones[1:])]
        out[d] = np.array([h & quality_rules.BUCKETS - 1 for h in ones + pairs], np.int64)
    return out


def test_rules_without_rows_or_trusted(spark):
    docs = odd_rows(spark)
    assert quality_rules.judge(docs.limit(0), docs.select("doc_id").limit(0)).count() == 0
    assert {r["score"] for r in quality_rules.judge(docs, docs.select("doc_id").limit(0), prefix="").select("score").collect()} == {0.0}


def test_mixing_on_odd_rows(spark):
    docs = odd_rows(spark)
    docs.createOrReplaceTempView("odd_documents")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    sql = entry.oracle_sql()["op7_mixing"]
    assert oracle.difference(mixing.mix(docs), con, sql) is None
    rows = mixing.mix(docs).collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    words = sum(len(words_of(r["text"])) for r in again.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    silent = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(silent).collect()} == {(0, 0.0, 0)}


def test_mixing_comes_near_its_targets(spark):
    rows = entry.queries()["op7_mixing"](spark, "/root/testdata/sf0.01").collect()
    docs = duckdb.sql("SELECT doc_id, source FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    source = dict(docs)
    taken, goal, largest = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
        goal[s] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)


def test_bpe_equals_the_library():
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encode, decode = bpe.Encoder(RANKS, public_tokenizers.PATTERN), bpe.Decoder(RANKS)
    rng = random.Random(1)
    letters = "abcdeinorst  \n\t'éèß中文字🙂ﬀ́#$%0123456789ABC<>.,"
    texts = ["", "a" * 3000, " " * 500, "x<|endoftext|>y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(150)]
    for text in texts * 2:
        ids = np.frombuffer(encode(text), "<u4")
        assert ids.tolist() == known.encode_ordinary(text)
        assert decode(ids.tobytes()) == text
    tiny = bpe.Encoder(RANKS, public_tokenizers.PATTERN, max_pieces=3)
    tiny.transducer.max_states = 5
    assert all(tiny(t) == encode(t) for t in texts[:200])
    old, bpe.STRETCH_PIECES = bpe.STRETCH_PIECES, 3
    try:
        assert all(tiny(t) == encode(t) for t in texts[:100])
    finally:
        bpe.STRETCH_PIECES = old


def test_bpe_splits_by_the_same_unicode_as_the_library():
    # Bordering characters of two bytes that share a token: where the split differs, so do the ids.
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ["\U00018e48蜯", "\U00011dc8辻", "a\U00018e48蜯 \U00011de1\U00011de2x", " \u088f\u088fب1\U0001fa8e!"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == known.encode_ordinary(text)
    # Over all code points: a piece is a letter, number or space alone, or it is not.
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes((b,)): b for b in range(256)}
    for kind in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"):
        found = bpe.Encoder(single, kind)(every)
        assert found == np.array(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every), "<u4").tobytes()


def test_any_ids_decode_as_a_stream():
    token = {rank: data for data, rank in RANKS.items()}
    decode, rng = bpe.Decoder(RANKS), random.Random(2)
    for _ in range(600):
        ids = np.array([rng.randrange(len(RANKS)) if rng.random() < 0.5 else rng.randrange(100, 256) for _ in range(rng.randint(0, 9))], np.int64)
        want = b"".join(token[i] for i in ids.tolist()).decode("utf-8", "replace")
        assert "".join(decode.stream(ids[k:k + 1] for k in range(len(ids)))) == want
        assert "".join(decode.stream([ids])) == want


def test_bpe_query_and_odd_rows(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    for r in entry.queries()["op10_bpe"](spark, FOLDER).collect():
        ids = np.array(known.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        sha = hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha)
    docs = odd_rows(spark).withColumn("ids", F.lit("mine"))
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert found.columns == [*docs.columns, "_ids"]
    for r in found.collect():
        assert r["_ids"] == known.encode_ordinary(r["text"] or "")
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokenizer_file_is_readable():
    assert Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab_size() == 50_257
