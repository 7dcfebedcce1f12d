"""Mixing sources to target weights along a curriculum.

Sizes are tokens of a public tokenizer. A source's *share* is its weight over
the sum of all listed weights; what it may take is bounded by ``max_repeats``
times its own size. What a capped source can't take is handed to the others in
proportion to their weights (water filling), so that the total stays the size
of the whole corpus as far as the caps allow.

Every document of a source is taken ``d // s`` times whole (d tokens demanded,
s tokens there), and the documents that come first in a fixed random order once
more, up to the demand. Training positions follow a weight schedule that
changes over time: source i asks for tokens at the rate
``1 + tilt_i * (2t - 1)`` over t in [0, 1]; integrated, this gives its
cumulative demand, and inverting that at the middle of each copy gives the
copy's position. Documents are then range-sorted by position.

Nothing here gathers a source in one task: running totals come from totals per
(source, bucket) - a small table - and sums inside buckets of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.llm.tokens import DEFAULT_VOCABULARY, count
from tabularium.sources.tables import cut

BUCKET_ROWS = 20_000  # documents a bucket holds on average; the number of buckets follows from the corpus


def _sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, written once: both later passes read it."""
    return cut(count(documents, ("doc_id", "source"), vocabulary))


def allot(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes(source, size), targets(source, weight, max_repeats) -> shares and demand of each listed source.

    Columns: source, weight, max_repeats, size, target_share, target_tokens,
    cap_tokens, demand. The number of sources is that of ``targets``; repeated
    rows of a source count once (least max_repeats), null or non-positive
    weights and null sources are left out. Water filling is closed-form: with
    sources in order of cap / weight, the level is the first at which the rest
    of the total, spread over the rest of the weights, fits under every cap.
    """
    listed = targets.where("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(F.max("weight").alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("total"))
    known = listed.join(sizes.where("source is not null"), "source", "left").select("source", "weight", "max_repeats", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    known = known.join(F.broadcast(total)).withColumn("cap", F.col("size").cast("double") * F.col("max_repeats")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # one row per listed source: a single window over the list itself, not over documents
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("ratio", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    known = (
        known.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
    )
    # sources whose cap lies under the level are filled; the first that isn't sets the level for the rest
    fits = F.col("ratio") >= F.col("level")
    known = known.withColumn("final_level", F.min(F.when(fits, F.struct("ratio", "source", "level"))).over(everything)["level"])
    demand = F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap")))
    return known.select(
        "source",
        "weight",
        F.col("max_repeats").cast("long").alias("max_repeats"),
        "size",
        (F.col("weight") / F.col("all_weights")).alias("target_share"),
        (F.col("weight") / F.col("all_weights") * F.col("total")).alias("target_tokens"),
        F.col("cap").alias("cap_tokens"),
        F.greatest(demand, F.lit(0.0)).alias("demand"),
    )


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, tilt: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(taken, shares).

    taken(doc_id, source, n_tokens, times, position): every document, how often
    it is taken and the training position in [0, 1] of its first copy (null if
    not taken). shares(source, weight, max_repeats, size, target_share,
    target_tokens, demand, actual_tokens, actual_share, missing_tokens).

    Documents with a null or unlisted source are taken 0 times, as are those of
    a source with max_repeats 0. Documents without tokens (null and empty texts)
    follow their neighbours in the order. Sources that must be repeated are
    tilted to the end (rate rising), the others to the start: scarce material
    comes back late. ``tilt`` in [0, 1) is the strength.
    """
    sized = _sized(documents, vocabulary)
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    plan = cut(allot(sizes, targets))
    # rows per bucket bounded by the count of the corpus; ids hash evenly, so a hot source spreads over all buckets
    n_buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    order = F.xxhash64("doc_id", F.lit("order"))
    rows = sized.join(F.broadcast(plan.select("source", "size", "demand", "max_repeats")), "source", "left").withColumn("o", order)
    rows = rows.withColumn("b", F.floor((F.col("o") / F.lit(2.0**64) + F.lit(0.5)) * n_buckets).cast("long"))
    per = rows.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    start = per.select("source", "b", (F.sum("t").over(Window.partitionBy("source").orderBy("b")) - F.col("t")).alias("before"))
    inside = Window.partitionBy("source", "b").orderBy("o", "doc_id", "n_tokens")
    rows = rows.withColumn("run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    rows = rows.join(start.withColumnRenamed("source", "s2").withColumnRenamed("b", "b2"), (F.col("source").eqNullSafe(F.col("s2"))) & (F.col("b") == F.col("b2")), "left").withColumn("at", F.col("run") + F.col("before"))
    whole = F.when((F.col("size") > 0), F.floor(F.col("demand") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("demand") - F.col("whole") * F.col("size")
    extra = (F.col("at") + F.col("n_tokens") / 2.0 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("whole") < F.col("max_repeats"))
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(0))).withColumn("rest", F.coalesce(rest, F.lit(0.0)))
    rows = rows.withColumn("times", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))
    # first copy: its middle as a share of the source's demand, through the inverse of the cumulative demand
    y = F.least(F.lit(1.0), (F.col("at") + F.col("n_tokens") / 2.0) / F.col("demand"))
    rows = rows.withColumn("position", F.when((F.col("times") > 0) & (F.col("demand") > 0), invert(y, F.when(F.col("demand") > F.col("size"), F.lit(tilt)).otherwise(F.lit(-tilt)))))
    taken = rows.select("doc_id", "source", "n_tokens", "times", "position")
    got = taken.groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("actual_tokens"))
    shares = plan.join(F.broadcast(got), "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    sum_all = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.select(
        "source", "weight", "max_repeats", "size", "target_share", "target_tokens", "demand", "actual_tokens",
        F.when(sum_all > 0, F.col("actual_tokens") / sum_all).otherwise(F.lit(0.0)).alias("actual_share"),
        F.greatest(F.col("target_tokens") - F.col("actual_tokens"), F.lit(0.0)).alias("missing_tokens"),
    )
    return taken, shares


def invert(y, a):
    """t with (1 - a) t + a t^2 = y: the time at which a share y of the demand has been asked for."""
    return F.when(F.abs(a) < 1e-9, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / (2 * a))


def sequence(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, tilt: float = 0.5) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens): every copy at its training position, range-sorted by it.

    Copy c of a document lies c - 1 whole source sizes behind its first copy in
    the source's demand. The rows are those of the mix: at most max_repeats a
    document. Sorting is by range partitioning, each partition sorted by itself.
    """
    taken, shares = mix(documents, targets, vocabulary, tilt)
    info = shares.select("source", "size", "demand")
    a = F.when(F.col("demand") > F.col("size"), F.lit(tilt)).otherwise(F.lit(-tilt))
    first = (1 - a) * F.col("position") + a * F.col("position") * F.col("position")
    copies = taken.where("times > 0").join(F.broadcast(info), "source").withColumn("y0", first).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    y = F.least(F.lit(1.0), F.col("y0") + (F.col("copy") - 1) * F.col("size") / F.col("demand"))
    out = copies.select(invert(y, a).alias("position"), "doc_id", "source", "copy", "n_tokens")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")
