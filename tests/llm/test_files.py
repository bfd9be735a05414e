"""WARC archives, token files, vector search and the pipeline."""

import hashlib
import io
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import range_coder, token_files, vector_search, warc
from tickloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def records(count):
    rng = np.random.default_rng(count)
    return [warc.record_bytes(f"urn:x-page:{k}", f"http://h/{k}\r\nX: y", rng.integers(32, 127, 40 * k, dtype=np.uint8).tobytes()) for k in range(count)]


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_archives_are_salvaged(packed):
    parts = [warc.member(r) if packed else r for r in records(40)]
    whole = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    clean = list(warc.salvage(io.BytesIO(whole)))
    assert [c[0] for c in clean] == ["record"] * 40 and [c[2] for c in clean] == ends.tolist()
    rng = np.random.default_rng(7)
    for turn in range(60):
        data, hurt = bytearray(whole), int(rng.integers(1, 39))
        # Nothing checks the header lines of a record outside a member, so only its block is hurt.
        first = 0 if packed else parts[hurt].index(b"\r\n\r\n") + 4
        at = int(ends[hurt - 1]) + int(rng.integers(first, len(parts[hurt]) - 34))
        kind = turn % 4
        if kind == 0:
            data[at] ^= 0x55
        elif kind == 1:
            del data[at:at + int(rng.integers(1, 30))]
        elif kind == 2:
            data[at:at] = rng.integers(0, 256, 20, dtype=np.uint8).tobytes()
        else:
            data = data[:at]
        found = list(warc.salvage(io.BytesIO(bytes(data))))
        assert [f[1] for f in found] == [0, *[f[2] for f in found[:-1]]] and (not found or found[-1][2] == len(data))
        ids = {f[4]["record_id"] for f in found if f[0] == "record"}
        expected = {f"urn:x-page:{k}" for k in range(40) if k < hurt - 1 or (k > hurt + 1 and kind != 3)}
        assert expected <= ids
        for f in found:
            if f[0] == "record":
                k = int(f[4]["record_id"].split(":")[-1])
                assert hashlib.sha1(f[4]["payload"]).hexdigest() == f[4]["payload_digest"] and f[4]["payload_bytes"] == 40 * k
            else:
                assert f[3]
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [g[:3] for g in warc.salvage(io.BytesIO(b"nothing here"))] == [("gap", 0, 12)]


def ids_of(data):
    return {int(f[4]["record_id"].split(":")[-1]) for f in warc.salvage(io.BytesIO(data)) if f[0] == "record"}


def hurt_block(record):
    bad = bytearray(record)
    bad[record.index(b"\r\n\r\n", record.index(b"\r\n\r\n") + 4) + 10] ^= 0x55
    return bytes(bad)


def test_damage_in_a_member_of_many_records_costs_one():
    parts = records(20)
    for k in (1, 7, 19):
        found = list(warc.salvage(io.BytesIO(warc.member(b"".join([*parts[:k], hurt_block(parts[k]), *parts[k + 1:]])))))
        assert {int(f[4]["record_id"].split(":")[-1]) for f in found if f[0] == "record"} == set(range(20)) - {k}
        gap = [f for f in found if f[0] == "gap"]
        assert len(gap) == 1 and gap[0][3] == "block digest"
        assert gap[0][4] == {"member": 0, "content_first": len(b"".join(parts[:k])), "content_end": len(b"".join(parts[:k + 1]))}
    three = [warc.member(b"".join(p)) for p in (parts[:7], [*parts[7:9], hurt_block(parts[9]), *parts[10:14]], parts[14:])]
    assert ids_of(b"".join(three)) == set(range(20)) - {9}
    long = bytearray(b"".join(parts))
    at = long.index(b"Content-Length: ", len(b"".join(parts[:5])))
    long[at + 16:at + 17] = b"99999999"
    assert set(range(20)) - {5} <= ids_of(warc.member(bytes(long)))


@pytest.mark.parametrize("share", [0.05, 0.3, 0.6, 0.95])
def test_records_before_the_end_of_a_broken_member_are_kept(share):
    """All records that are complete before the cut, or before a byte that cannot be inflated, and all of the next member."""
    parts = [warc.record_bytes(f"urn:x-page:{k}", "http://h", np.random.default_rng(k).integers(32, 127, 3000, dtype=np.uint8).tobytes()) for k in range(20)]
    data = warc.member(b"".join(parts[:15]))
    cut = data[:int(len(data) * share)]
    whole = zlib.decompressobj(31).decompress(cut)
    complete = sum(len(b"".join(parts[:k + 1])) <= len(whole) for k in range(15))
    assert ids_of(cut) == set(range(complete))
    rest = warc.member(b"".join(parts[15:]))
    found = list(warc.salvage(io.BytesIO(cut + rest)))
    have = {int(f[4]["record_id"].split(":")[-1]) for f in found if f[0] == "record"}
    assert have >= {*range(max(0, complete - 1)), *range(15, 20)} and have <= {*range(complete + 1), *range(15, 20)}
    assert [f[1] for f in found] == [0, *[f[2] for f in found[:-1]]] and found[-1][2] == len(cut + rest)
    assert any(f[0] == "gap" and f[3] for f in found)


def test_a_stated_length_beyond_the_file_is_not_read():
    class Counted(io.BytesIO):
        most = 0

        def read(self, size=-1):
            Counted.most = max(Counted.most, size)
            return super().read(size)

    parts = records(3)
    data = parts[1].replace(b"Content-Length: ", b"Content-Length: 9999999999", 1) + parts[2]
    assert [f[0] for f in warc.salvage(Counted(data), len(data))] == ["gap", "record"] and Counted.most <= warc.READ_BYTES


def test_gaps_are_logged_by_the_spark_reader(spark, tmp_path):
    parts = [warc.member(r) for r in records(30)]
    parts[10] = b"\x00" * 300_000 + parts[10][:50]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    archives = spark.createDataFrame([("a.warc.gz",)], "archive string")
    rows = warc.read_archives(archives, str(tmp_path)).collect()
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["end"] - gaps[0]["first"] == len(parts[10]) and gaps[0]["reason"]
    assert sum(r["kind"] == "record" for r in rows) == 29


def odd_pages(spark):
    big = "same payload é " * 100
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "http://x/\n", ""), (None, "n", big), (None, "n", "y" * 1000), (None, "n", "y" * 1000),
            (7, "u", "s" * 999), (8, "u", "s" * 999), (9, "u", "s" * 1000), (10, "u", "s" * 1000), (10, "u", "s" * 1000), (11, "u", "WARC/1.1\r\n\r\n" * 9000),
            (12, "data:," + "%20a" * 25_000, "long url")]
    return spark.createDataFrame([(a, b, c, "clash", "clash") for a, b, c in rows], "page_id long, url string, html string, keeper string, kind string")


def test_warc_of_odd_pages(spark, tmp_path):
    for compressed in (True, False):
        folder = str(tmp_path / str(compressed))
        rows = warc.read_archives(warc.write_archives(odd_pages(spark), folder, compressed, archive_bytes=2000), folder).collect()
        assert {r["kind"] for r in rows} == {"record"} and len(rows) == 14
        have = sorted((r["record_id"].split(":")[-1], r["payload_bytes"], r["record_type"], (r["refers_to"] or ":").split(":")[-1]) for r in rows)
        assert have == sorted([
            ("1", 1600, "revisit", "2"), ("2", 1600, "response", ""), ("3", 0, "response", ""), ("4", 0, "response", ""), ("none", 1600, "revisit", "2"),
            ("none", 1000, "response", ""), ("none", 1000, "response", ""), ("7", 999, "response", ""), ("8", 999, "response", ""),
            ("9", 1000, "revisit", "10"), ("10", 1000, "response", ""), ("10", 1000, "response", ""), ("11", 108_000, "response", ""), ("12", 8, "response", ""),
        ])
        assert [r["uri"] for r in rows if r["record_id"].endswith(":12")] == ["data:," + "%20a" * 25_000]
    assert warc.round_trip(odd_pages(spark).limit(0)).count() == 0


def test_warc_query(spark):
    assert oracle.difference(entry.queries()["op3_warc"](spark, FOLDER), oracle.connect(FOLDER), entry.oracle_sql()["op3_warc"]) is None


def test_range_coder_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 129, 1000, 3000):
        for ids in (rng.integers(0, 1 << 16, n), np.zeros(n, np.int64), np.full(n, 65535), rng.zipf(1.3, n) % 50_257, np.resize(np.arange(37) * 999, n)):
            data = b"".join(range_coder.pack(ids, block=700, lanes=3))
            assert np.array_equal(range_coder.unpack(data, lanes=2), ids)
    repeated = b"".join(range_coder.pack(np.resize(rng.integers(0, 50_257, 50), 4000)))
    assert len(repeated) < 4000 * 0.2


def test_damaged_blocks_are_noticed():
    ids = np.random.default_rng(4).integers(0, 500, 3000)
    data = bytearray(b"".join(range_coder.pack(ids, block=1000)))
    for at in (0, 5, 20, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(range_coder.Corrupt):
            range_coder.unpack(bytes(bad))
    with pytest.raises(range_coder.Corrupt):
        range_coder.unpack(bytes(data[:-3]))


def test_guesses_are_not_searched_for(monkeypatch):
    k = np.arange(30_000)
    blocks = np.split(np.where(k % 5 < 2, k % 3000 * 17, k * k * 7919) % 50_257, 10)
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda keys, values, **how: asked.append(np.size(values)) or search(keys, values, **how))
    packed = range_coder.encode_blocks(blocks)
    # The format is as it was: frequencies that come with a guess are those a search gave.
    assert hashlib.sha1(b"".join(packed)).hexdigest() == "4c1b46788df3a3f4e030d87aa607886a2607eb84"
    asked.clear()
    found = range_coder.decode_blocks(packed, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(found, blocks))
    assert sum(asked) <= len(k) * 1.2


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def test_token_file_query(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.queries()["op9_token_files"](spark, FOLDER).collect()}
    start, want = 0, {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert found == want


def test_token_files_of_odd_rows(spark, definition):
    rows = [(3, None, 1), (1, "", 2), (None, "no id", 3), (2, "two <|endoftext|>", 4), (2, "two <|endoftext|>", 4), (2, "another", 5), (9, "word " * 50_000, 6),
            (-(1 << 63), "a <|endoftext|> b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = sorted(token_files.round_trip(docs, definition).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, -(1 << 63), 1, 2, 2, 2, 3, 9]
    coder = Tokenizer.from_str(definition)
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 2}
    for r in found:  # the stated call, in which the string of a special token is that token
        if r["doc_id"] != 2:
            assert r["ids"] == [*coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
    assert found[1]["ids"] == [64, 220, 50256, 275, 0]
    assert [r["start"] for r in found] == [0, *np.cumsum([len(r["ids"]) for r in found]).tolist()[:-1]]
    assert all(r["ids"][-1] == 0 for r in found) and found[2]["ids"] == [0] == found[6]["ids"]
    assert token_files.round_trip(docs.limit(0), definition).count() == 0


def test_nearest_vectors(spark):
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    found = {}
    for r in vector_search.nearest(table(spark, "/root/testdata/sf0.1", "embeddings"), list_rows=40).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = ids[ids % 20 == 0]
    assert sorted(found) == sorted(asked.tolist())
    hits = 0
    for q in asked.tolist():
        scores = v @ v[ids == q][0]
        best = [i for _, i in sorted(zip(-scores, ids.tolist())) if i != q][:20]
        got = [found[q][k] for k in range(1, 21)]
        hits += len(set(best) & {i for i, _ in got})
        assert got == sorted(got, key=lambda g: (-g[1], g[0])) and q not in {i for i, _ in got}
        assert all(s == pytest.approx(float(scores[ids == i][0]), abs=1e-9) for i, s in got)
    assert hits >= 0.9 * 20 * len(asked)


def test_every_list_within_the_ratio_is_searched(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6000, 64))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 3)
    vectors = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    rows = vector_search.usable(vectors)
    index, _ = vector_search.fit(rows, 8)
    queries = vector_search.as_queries(v[::600], index.length)
    dist = np.linalg.norm(queries[:, None] - index.centroids[None], axis=2)
    want = (dist <= vector_search.RATIO * dist.min(axis=1, keepdims=True)).sum(axis=1)
    assert len(index.centroids) == 750 and want.max() > vector_search.WIDTH
    found = vector_search._listed(rows.filter("vec_id % 600 = 0"), index, "query_id", True)
    lists = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.sum(F.length(F.regexp_replace(F.conv(F.hex("lists"), 16, 2), "0", "")))).collect()}
    assert [lists[q] for q in range(0, 6000, 600)] == pytest.approx(want, abs=1)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]),
            (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (40, [3.0, 1.0]), (60, None)]
    vectors = spark.createDataFrame([(a, b, "clash") for a, b in rows], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in vector_search.nearest(vectors).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found[0]) == [(1, 40, 3.0), (2, 1, 2.0), (3, 2, 2.0), (4, 20, -1.0)]
    assert sorted(found) == [0, 20, 40] and [i for _, i, _ in sorted(found[20])] == [0, 1, 2, 40]
    assert vector_search.nearest(vectors.limit(0)).count() == 0
    many = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(300)], "vec_id long, embedding array<float>")
    rows = vector_search.nearest(many, list_rows=2, block=16).collect()
    assert len(rows) == 15 * 20
    for r in rows:
        q, x = r["query_id"], r["vec_id"]
        assert r["score"] == (q % 7) * (x % 7) + 1 + (q % 3) * (x % 3)


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (9_000_001, "", "en", "s", 0)], docs.schema)
    rows = docs.unionByName(odd)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, rows, FOLDER)
        if name != names[-1]:
            assert made.columns == docs.columns
        rows = spark.createDataFrame(made.collect(), made.schema)
        counts.append(rows.count())
    assert counts[0] < docs.count() + 2 and counts[2] < counts[1] and counts[3] != counts[2] and counts[4] == counts[3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
