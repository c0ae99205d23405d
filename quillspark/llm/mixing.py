r"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order that depends on ``doc_id`` alone. A document's copy in pass ``e`` over
its source (``e`` = 0, 1, 2) has the virtual finish time

    (words of its source up to and with it + e * words of its source) / the source's target

All copies are range-sorted by finish time over the whole corpus, and the mix takes them from the front until the next
would pass the total budget.

Targets: sources in code-point order, null last, weigh 1, 2, 3 and so on repeating, and share the words of all documents
(the budget). A target stops at ``max_passes`` times its source's words; the excess goes to the others by weight until no
target is above its limit. That water level is found in closed form: with the sources ordered by limit / weight, those
before the level are at their limits, and the level is what they leave over the weights that remain.

All running sums (words in a source, sources before a source, limits before a ratio, words before a finish time) come from
sorted ranges and the sums of whole ranges (:func:`base.range_prefix`), so that no task holds a source, all sources or all
copies of one time. The cut is one place in the order, and whether a copy lies before it is told by its own columns.

Defined results: a null text has size 0; an empty table gives an empty result; documents of size 0 take 0 words, and where
no document has a word every target is 0; a null ``doc_id`` is a document like others; rows that repeat a ``doc_id`` are
separate documents; equal rows are interchangeable; a text of any length is one number here. Other columns aren't read but
for ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import drop_materialized, fresh, materialize, range_prefix

#: A word, for sizes: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_passes: int = 3) -> DataFrame:
    """sources (skey, source_size; a row each) with ``before`` (words of the sources before it), ``budget`` and ``target``."""
    placed = range_prefix(sources.withColumn("one", F.lit(1).cast("long")), ["skey"], {"place": "one", "upto": "source_size"})
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = materialize(
        placed.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("lim", F.col("source_size") * max_passes)
        .withColumn("ratio", F.col("lim") / F.col("weight"))
        .select("skey", "source_size", "weight", "lim", "ratio", (F.col("upto") - F.col("source_size")).alias("before"))
    )
    budget, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ranked = range_prefix(weighed.select("ratio", "skey", "lim", "weight"), ["ratio", "skey"], {"limits": "lim", "passed": "weight"})
    level = (F.lit(budget) - F.col("limits") + F.col("lim")).cast("double") / (F.lit(weight) - F.col("passed") + F.col("weight"))
    water = ranked.select("ratio", "skey", level.alias("level")).filter("level <= ratio").agg(F.min(F.struct("ratio", "skey", "level")).alias("x")).first()["x"]  # one row
    return weighed.select("skey", "source_size", "before", F.lit(budget).alias("budget"), F.least(F.col("lim").cast("double"), F.lit(water["level"] if water else 0.0) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_passes: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the columns ``keep``, doc_id, source, size, source_size, target, copies (times taken) and taken (words).

    keep: columns that are handed through, and that put rows of one doc_id and size in order.
    """
    kept = fresh(["doc_id", "source", "skey", "key", "size", "row", "upto", "source_size", "before", "budget", "target"], *[f"keep_{k}" for k in range(len(keep))])
    sized = docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source"))).alias("skey"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)],
        F.monotonically_increasing_id().alias("row"),  # deals out rows that are equal otherwise
    )
    sized = materialize(sized)
    shares = materialize(targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, max_passes))
    queued = range_prefix(sized, ["skey", "key", "doc_id", "size", *kept, "row"], {"upto": "size"})
    queued = materialize(queued.drop("key", "row").join(shares, "skey").withColumn("upto", F.col("upto") - F.col("before")).drop("before"))
    drop_materialized(sized, shares)

    def time(v: Column) -> Column:
        return v / F.col("target")

    # A copy's place in the order: its time, its source, and the words of its source up to it (no two copies share all three).
    places = F.array(*[F.col("upto") + F.lit(e) * F.col("source_size") for e in range(max_passes)])
    copies = queued.filter("size > 0").select("skey", "size", "target", "budget", F.explode(places).alias("v"))
    reached = range_prefix(copies.select(time(F.col("v")).alias("t"), "skey", "v", "size", "budget"), ["t", "skey", "v"], {"reached": "size"})
    last = reached.filter("reached <= budget").agg(F.max(F.struct("t", "skey", "v")).alias("x")).first()["x"]  # one row
    if last is None:  # no document has a word
        times = F.lit(0)
    else:
        cut = F.struct(F.lit(last["t"]).cast("double").alias("t"), F.lit(last["skey"]).alias("skey"), F.lit(last["v"]).cast("long").alias("v"))
        inside = F.filter(places, lambda v: F.struct(time(v).alias("t"), F.col("skey").alias("skey"), v.alias("v")) <= cut)
        times = F.when(F.col("size") > 0, F.size(inside)).otherwise(0)
    found = queued.withColumn("copies", times.cast("int"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
