"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a hash. A source that is to give a share of its words gives the documents whose hash lies below a
threshold, so a larger budget takes the same documents and more. The threshold is found from histograms: words are
summed by source and leading digits of the hash, the running sum shows the bucket in which the budget ends, and only
that bucket is divided further, digit by digit. Budgets above the size of a source take it whole, as often as they can,
and the threshold decides about the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, fresh, stored
from tickloom.operators.ordering import positions
from tickloom.operators.tables import small_side

DIGITS, DIGIT_BITS = 5, 12  # the hash has 60 bits
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, so that rows with one id but other texts are told apart."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", doc_id.cast("string"), text)), 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def targets(measured: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) with ``share`` of all words dealt out by weight.

    Sources take the weights in turn, in the order of their names by code point, null last. No target exceeds ``most``
    times the words of its source; what is over goes to the others by weight, until none is above.
    """
    sums = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(stored(sums, "source-sizes"), ["source"], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(ranked.select("source", "source_size", F.get(turn, (F.col("place") % len(weights)).cast("int")).alias("weight")), "source-weights")
    # One row of sums per round comes to the driver. A round's level only rises, so sources once full stay full.
    level, limit = 0.0, F.col("source_size") * most
    while True:
        full = F.col("weight") * level >= limit
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        new = (share * row["all"] - most * (row["full"] or 0)) / row["weight"]
        if new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(F.col("weight") * level, limit).cast("double").alias("target"))


def thresholds(measured: DataFrame, budgets: DataFrame, digits: int = DIGITS, bits: int = DIGIT_BITS) -> DataFrame:
    """(source, bound): documents of the source with a hash below ``bound`` have about ``budget`` words together.

    One histogram per digit. Those after the first read only the documents of the bucket in which the budget ends. What
    lies on the last boundary, documents with one and the same hash, is taken if that comes closer to the budget.
    """
    state = budgets.select(F.col("source").alias("s"), F.col("budget").cast("double").alias("left"), F.lit(0).cast("bigint").alias("low"))
    total = digits * bits
    for digit in range(digits):
        shift = total - bits * (digit + 1)
        side = small_side(state)
        at = measured.join(side, measured["source"].eqNullSafe(side["s"]) & (F.shiftright(measured["hash"], shift + bits) == F.shiftright(side["low"], shift + bits)))
        counts = at.groupBy("s", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        # At most 2 ** bits buckets of one source meet here.
        order = Window.partitionBy("s").orderBy("bucket")
        run = counts.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        run = run.withColumn("before", F.coalesce("before", F.lit(0).cast("bigint"))).filter(F.col("before") < F.col("left"))
        # The last bucket that begins below the budget.
        cut = run.groupBy("s").agg(F.max_by(F.struct("bucket", "n", "before", "left"), "bucket").alias("b"))
        state = stored(cut.select(
            "s", (F.col("b.left") - F.col("b.before")).alias("left"), F.shiftleft(F.col("b.bucket"), shift).alias("low"), F.col("b.n").alias("n"),
        ), "boundary")
    closer = F.col("n") - F.col("left") < F.col("left")
    return state.select(F.col("s").alias("source"), F.when(closer, F.col("low") + 1).otherwise(F.col("low")).alias("bound"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The measured documents (doc_id, source, size, hash) and, per source, its size, target, whole copies and bound."""
    measured = stored(sizes(docs), "sizes")
    goals = targets(measured, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("copies", F.least(F.floor(ratio), F.lit(int(most))).cast("bigint"))
    goals = stored(goals.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "goals")
    bounds = thresholds(measured, goals.filter("budget > 0").select("source", "budget"))
    rule = goals.join(bounds.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("bound", F.lit(0).cast("bigint")).alias("bound"),
    )
    return measured, stored(rule, "mixing-rule")


def mix(docs: DataFrame, **parameters: float) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document; ``taken`` counts words with repeats.

    Null texts have no words and null sources are a source of their own, last in order. Repeated rows share their hash
    and are taken or left together. No words at all give targets of 0. No row exceeds twice its size.
    """
    measured, rule = plan(docs, **parameters)
    side = small_side(rule.withColumnRenamed("source", "s"))
    joined = measured.join(side, measured["source"].eqNullSafe(side["s"]))
    copies = F.col("copies") + F.when(F.col("hash") < F.col("bound"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, **parameters: float) -> DataFrame:
    """``docs`` as the mix has them: rows left out, kept, or repeated. Columns stay as they are, whatever their names."""
    _, rule = plan(docs, **parameters)
    names = {k: fresh(docs, f"__mix_{k}") for k in ("s", "copies", "bound", "hash", "turn")}
    side = small_side(rule.select(F.col("source").alias(names["s"]), F.col("copies").alias(names["copies"]), F.col("bound").alias(names["bound"])))
    hashed = docs.withColumn(names["hash"], document_hash(F.col("doc_id"), F.col("text")))
    joined = hashed.join(side, hashed["source"].eqNullSafe(F.col(names["s"])))
    copies = F.col(names["copies"]) + F.when(F.col(names["hash"]) < F.col(names["bound"]), 1).otherwise(0)
    return joined.withColumn(names["turn"], F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
