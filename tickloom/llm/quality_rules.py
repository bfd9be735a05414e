"""Quality rules from hashed n-gram likelihoods, with column functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted, one of trusted target documents and one of the whole corpus. A document's score is the mean over its n-grams of
log(target / corpus); it is kept if the score reaches a fixed threshold and the simple counts raise no objection. Nothing
is drawn at random, so each document has the same verdict in every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh
from tickloom.operators.tables import small_side

BUCKETS = 1 << 14
THRESHOLD = -0.06
SMOOTHING = 1.0  # added to every bucket of both multinomials
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` mentions it.

    A column of its own is no substitute: the optimizer puts its expression back in, also into functions of elements.
    """
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _neighbours(hashes: Column, step: int) -> Column:
    """Each hash joined with the one ``step`` places on; only as many as have one."""
    joined = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))
    return F.slice(joined, 1, F.greatest(F.size(hashes) - step, F.lit(0)))


def _repeated_words(windows: Column) -> Column:
    """Words that lie in a window (by hash) found twice or more; windows overlap, so lengths are added up by gaps."""
    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1

        def twin(x: Column, i: Column) -> Column:
            same_before = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) & (i > 0)
            return same_before | (F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)) & (i < last))

        places = F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda a, x: a + x,
        ))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(ordered, covered))


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def _bucketed(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_buckets(text: Column) -> Column:
    """The buckets of all single words and word pairs of a whole text."""
    return let(_hashes(words_of(text)), lambda ones: F.concat(_bucketed(ones), _bucketed(_neighbours(ones, 1))))


def log_ratios(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, ratio): log of target over corpus probability for every bucket that the corpus has; at most BUCKETS rows.

    ``trusted`` has the ids of target documents, each of which counts as often as the corpus has it. N-grams are counted
    in the tasks that read them, so the shuffle carries at most BUCKETS rows a task. Without target words all ratios are 0.
    """
    ids = trusted.select(F.col("doc_id").alias("__trusted")).filter(F.col("__trusted").isNotNull()).distinct()
    texts = docs.select("doc_id", "text")
    side = small_side(ids)
    marked = texts.join(side, texts["doc_id"] == side["__trusted"], "left").select("text", F.col("__trusted").isNotNull().alias("is_target"))
    # The outer form: the other one would compute all n-grams a second time, for a filter on empty arrays.
    grams = marked.select("is_target", F.explode_outer(gram_buckets(F.col("text"))).alias("bucket"))
    counted = grams.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("is_target"), 1)).alias("target"),
    )
    totals = F.struct(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    held = counted.agg(F.collect_list(F.struct("bucket", "raw", "target")).alias("rows"), totals.alias("all"))
    row = held.select(F.explode("rows").alias("r"), "all")
    share = lambda one, whole: (one + smoothing) / (whole + smoothing * BUCKETS)
    ratio = F.log(share(F.col("r.target"), F.col("all.target")) / share(F.col("r.raw"), F.col("all.raw")))
    return row.select(F.col("r.bucket").alias("bucket"), F.when(F.col("all.target") > 0, ratio).otherwise(0.0).alias("ratio"))


def _table(ratios: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS ratios."""
    every = ratios.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(ratios, "bucket", "left").select("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio")))["ratio"].alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """``docs`` with the counts, ``score``, ``base_failed`` and ``kept`` for every row, from its whole text.

    Null and empty texts have no words: counts 0, score 0, failed and not kept. Repeated rows are judged alike, ids do
    not matter for the verdict, and other columns pass through; a new column whose name they have gets underscores in
    front. A score equal to the threshold is kept.
    """
    table = _table(log_ratios(docs.select("doc_id", F.col(text).alias("text")), trusted))
    # One row of BUCKETS numbers, read as a scalar; its size does not grow with the data.
    weights, held = fresh(docs, "__ratios"), fresh(docs, "__counts")
    ratios, source = F.col(weights), F.coalesce(F.col(text), F.lit(""))

    def total(hashes: Column) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(ratios, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))

    def by_hashes(words: Column, ones: Column, pairs: Column) -> Column:
        grams = F.size(ones) + F.size(pairs)
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            let(_neighbours(pairs, 2), lambda fours: let(_neighbours(fours, 4), _repeated_words)).alias("n_repeat_words"),
            F.when(grams > 0, (total(ones) + total(pairs)) / grams).otherwise(0.0).alias("score"),
        )

    counts = let(words_of(F.col(text)), lambda words: let(_hashes(words), lambda ones: let(
        _neighbours(ones, 1), lambda pairs: by_hashes(words, ones, pairs))))
    counted = docs.withColumn(weights, table.scalar()).withColumn(held, counts)
    n_words, repeated = F.col(f"{held}.n_words"), F.col(f"{held}.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    made = {
        "n_words": n_words, "word_chars": F.col(f"{held}.word_chars"),
        "n_symbols": F.regexp_count(source, F.lit(r"[#*$%&|<>]")).cast("bigint"), "n_dup_lines": _line_counts(F.col(text)),
        "n_repeat_words": repeated, "score": F.col(f"{held}.score"), "base_failed": failed,
        "kept": ~failed & (F.col(f"{held}.score") >= threshold),
    }
    return counted.select(*docs.columns, *[c.alias(fresh(docs, prefix + n)) for n, c in made.items()])
