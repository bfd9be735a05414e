"""Named queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    bpe, conversations, language_id, merkle, mixing, quality_classifier, quality_rules, secret_scan, simhash, token_files, toxicity,
    vector_search, warc,
)
from tickloom.llm.common import remainder, table
from tickloom.queries.registry import query


def held_out(divisor: int, rest: int) -> F.col:
    return F.coalesce(remainder("doc_id", divisor) == rest, F.lit(False)).alias("held_out")


@query()
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    trusted = labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    return quality_rules.judge(docs, trusted).drop("text")


@query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    score = F.col("quality_score")
    return scored.select(
        "doc_id", held_out(quality_classifier.FOLDS, 0), score.alias("score"),
        (score >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


# Equal payloads of at least 1000 bytes: the page with the largest id holds them.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@query(WARC_SQL)
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))

    def page(urn: str) -> F.col:
        return F.expr(f"try_cast(substring_index({urn}, ':', -1) AS bigint)")

    return found.filter("kind = 'record'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query()
def op4_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", held_out(language_id.FOLDS, 0), "lang_pred", "score", "rejected")


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


# Sizes and hashes per document; caps rise by the share of a source that is full; the running sum in order of the hash
# shows which documents lie below the budget, and the last one is taken if that comes closer.
MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || md5(concat_ws('|', doc_id::VARCHAR, text))[1:15])::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s
), ranked AS (
  SELECT *, 2.0 * source_size / weight AS level,
         coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after,
         sum(source_size) OVER () AS every
  FROM w
), water AS (
  SELECT arg_min((1.5 * every - 2.0 * full_before)::DOUBLE / weight_after, level) FILTER (WHERE (1.5 * every - 2.0 * full_before)::DOUBLE / weight_after <= level) AS lvl FROM ranked
), goals AS (
  SELECT source, source_size, least(weight * lvl, 2.0::DOUBLE * source_size)::DOUBLE AS target FROM w, water
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS copies,
         target - (CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END) * source_size AS budget
  FROM goals
), run AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, hash) AS own
  FROM d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN budget > 0 AND upto - own < budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""


@query(MIXING_SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    score = F.col("toxic_score")
    return scored.select(
        "doc_id", held_out(toxicity.FOLDS, toxicity.HELD_OUT), score.alias("score"),
        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    found = token_files.round_trip(table(spark, folder, "documents"), definition)
    return found.select("doc_id", "start", F.size("ids").cast("bigint").alias("n_tokens"), "ids_crc32")


@query()
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# crc32 of a text of ASCII characters, bit by bit.
def crc32_sql(text: str) -> str:
    step = "lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END"
    folded = f"list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), {step})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda s, b: {folded}), 4294967295::UBIGINT)"


def leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# One tree per source and one over the subroots; a leaf's path is the runs above it, folded step by step.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {leaf_sql("text")} AS leaf, {crc32_sql("doc_id::VARCHAR")} % 2 = 0 AS touched,
         {leaf_sql("replace(text, chr(10), '')")} AS tampered FROM documents
), ranked AS (
  SELECT doc_id, source, leaf, CASE WHEN touched THEN tampered ELSE leaf END AS given,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), tree AS (
  SELECT source, 0 AS l, pos, leaf AS h, n FROM ranked
  UNION ALL
  SELECT source, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, l, pos // 3, n
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS l, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, pos // 3, n
), leaves AS (
  SELECT row_number() OVER () AS k, r.*, s.subroot, s.pos AS top_pos FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source
), runs AS (
  SELECT k, l AS step, t.pos, t.h, t.pos - r.pos // power(3, l)::BIGINT AS side
  FROM leaves r JOIN tree t ON t.source IS NOT DISTINCT FROM r.source AND t.n > 1 AND t.pos // 3 = r.pos // power(3, l + 1)::BIGINT
  UNION ALL
  SELECT k, 1000 + l, t.pos, t.h, t.pos - r.top_pos // power(3, l)::BIGINT
  FROM leaves r JOIN top t ON t.n > 1 AND t.pos // 3 = r.top_pos // power(3, l + 1)::BIGINT
), steps AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY step) AS i, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE side < 0), '') AS before,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE side > 0), '') AS behind
  FROM runs GROUP BY k, step
), folded AS (
  SELECT k, 0::BIGINT AS i, given AS h FROM leaves
  UNION ALL
  SELECT f.k, s.i, sha256(s.before || f.h || s.behind) FROM folded f JOIN steps s ON s.k = f.k AND s.i = f.i + 1
), ended AS (
  SELECT k, arg_max(h, i) AS folded_root FROM folded GROUP BY k
), proof AS (
  SELECT k, string_agg(before || behind, '' ORDER BY i) AS text FROM steps GROUP BY k
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(text, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN ended USING (k) LEFT JOIN proof USING (k), (SELECT h AS root FROM top WHERE n = 1)
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof, tried on documents of which every other one may have lost its line breaks."""
    columns = ["doc_id", "source", "lang", "n_chars"]
    docs = table(spark, folder, "documents").select(*columns, "text")
    touched = remainder("doc_id", 2) == 0
    tampered = F.when(touched, merkle.leaf([*columns, F.translate("text", "\n", "")])).alias("tampered")
    manifest = merkle.build(docs, "source", ["doc_id"], merkle.leaf([*columns, "text"]), [F.col("doc_id"), tampered])
    proofs = merkle.proofs(manifest).select(
        "row.doc_id", "leaf", "siblings", "shape", "subroot", "root", F.coalesce("row.tampered", "leaf").alias("given")
    )

    def text(digest: str) -> F.col:
        return F.lower(F.hex(digest))

    return merkle.fold(proofs, "given").select(
        "doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def spans_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """(k, start, stop, place, kind, value) of a pattern's matches; what lies between them gives their places."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT k, opens AS start, opens + length(hit) AS stop, {place} AS place, '{kind}' AS kind, value FROM (
    SELECT k, unnest(hits) AS hit, unnest(vals) AS value,
           unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) AS opens
    FROM (SELECT k, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals,
                 regexp_split_to_array(text, '{quoted}') AS gaps FROM d))
  WHERE length(value) >= {least}"""


def secrets_sql() -> str:
    """Either case only for ASCII letters, spelt out here: the ``i`` flag knows further ones."""
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    assign = secret_scan.ASSIGN[0].replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{word})")
    kinds = {**secret_scan.BASE, "assign": (assign, *secret_scan.ASSIGN[1:])}
    base = " UNION ALL ".join(spans_sql(k, i, *p) for i, (k, p) in enumerate(kinds.items()))
    mixed = " AND ".join(f"regexp_matches(value, '{c}')" for c in secret_scan.TOKEN_CLASSES)
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, source, source || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS text FROM documents
), base AS MATERIALIZED ({base}
), tokens AS ({spans_sql("owned", len(secret_scan.BASE), secret_scan.TOKEN, 0, 20)}
), found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM tokens t WHERE {mixed} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = t.k AND b.start < t.stop AND t.start < b.stop)
), owners AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || repository, '') || chr(10) || coalesce('=' || source, '')) AS repositories
  FROM found JOIN d USING (k) GROUP BY value
), judged AS (
  SELECT *, owners >= {secret_scan.COPIED_OWNERS} OR repositories >= {secret_scan.COPIED_REPOSITORIES} AS copied FROM found JOIN owners USING (value)
), listed AS (
  SELECT k, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE copied) AS n_copied,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (WHERE kind <> 'owned') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM judged WHERE kind <> 'owned' OR NOT copied GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (k)
"""


@query(secrets_sql())
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A source owns its documents, and those of one language are one of its repositories."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    repository = F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("")))
    found = secret_scan.scan(docs, repository=repository)
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))

    def number(kind: int) -> F.col:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.BASE)],
        F.size(F.filter("spans", lambda s: s["copied"])).cast("bigint").alias("n_copied"), F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


# The least (cost, audit) per row and state, row by row, with up to two inserted messages before each row and after the last.
REPAIR_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, generate_series(1, 2) AS g(copy) WHERE f <> 0 AND (copy = 1 OR f = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM ordered
), faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen
), coded AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS bad, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id
), ins(s, t, letters, paid) AS (
  VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (2, 3, 'I', 3), (3, 2, 'I', 3),
         (0, 3, 'II', 6), (1, 3, 'II', 6), (2, 2, 'II', 6), (3, 3, 'II', 6)
), edit(s, t, letter, paid, initial) AS (
  VALUES (0, 0, 'D', 4, NULL), (1, 1, 'D', 4, NULL), (2, 2, 'D', 4, NULL), (3, 3, 'D', 4, NULL), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'),
         (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (0, 2, 'R', 3, NULL), (1, 2, 'R', 3, NULL), (3, 2, 'R', 3, NULL), (2, 3, 'R', 3, NULL)
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0::BIGINT, 'a': ''}} AS b FROM facts
  UNION ALL
  SELECT c.conv_id, c.i, e.t, min({{'c': (p.b.c + ins.paid + e.paid + CASE WHEN e.letter = 'D' THEN 0 ELSE c.extra END)::BIGINT, 'a': p.b.a || ins.letters || e.letter}})
  FROM best p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1 JOIN ins ON ins.s = p.s
       JOIN edit e ON e.s = ins.t AND (e.letter = 'D' OR NOT c.bad) AND (e.initial IS NULL OR e.initial = c.initial)
  GROUP BY c.conv_id, c.i, e.t
), done AS (
  SELECT f.conv_id, min({{'c': (b.c + paid)::BIGINT, 'a': b.a || letters}}) AS b
  FROM best JOIN facts f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.n = best.i JOIN ins USING (s) WHERE ins.t IN (0, 3) GROUP BY f.conv_id
), letters AS (
  SELECT conv_id, p, b.a[p] AS letter FROM (SELECT *, unnest(range(1, length(b.a) + 1)) AS p FROM done)
), placed AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS j
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), told AS (
  SELECT l.*, c.role, c.text, CASE WHEN letter = 'K' AND c.initial = 's' THEN 1 ELSE 0 END AS system
  FROM placed l LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.i = l.i AND letter <> 'I' WHERE letter <> 'D'
), said AS (
  SELECT conv_id, p, CASE WHEN letter = 'K' THEN role WHEN (j - max(system) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || coalesce(text, '') AS line FROM told
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS text FROM said GROUP BY conv_id
), named AS (SELECT DISTINCT conv_id FROM conversations)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(d.b.c, 0)::BIGINT AS cost, coalesce(d.b.a, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM named n LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM n.conv_id
     LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM n.conv_id
"""


@query(REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.repair(rows, present="present").withColumnRenamed("repaired", "repaired_sha256")
