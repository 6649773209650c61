"""Problem 7: a mix of sources in target shares of tokens, small sources repeated up to a cap, by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.llm.tokenizer import TOKENIZER_DIR, token_counts
from scoria.session import cut_lineage

#: Bins of the ranking, in which running totals are taken; only the bin where a quota ends is sorted.
BINS = 4096
#: Weights are rounded to so many steps for each doubling, so that a source has a bounded number of different ones.
STEPS = 256


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a row's key: the same in every run, on every partitioning and after a lost executor."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def allocate(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Quotas per source: ``source``, ``target_share``, ``max_copies``, ``n_docs``, ``source_tokens``, ``quota``, ``most_total``, ``limits``.

    sizes: ``source``, ``n_docs``, ``source_tokens`` of sources that have documents. total: tokens of the mix; null: as
    many as the caps allow with every available source in proportion. ``most_total`` is the size of a mix that the source's
    own cap would allow, so the least of them limits the mix, and ``limits`` says whether it does.
    Targets without tokens have quota 0; sources without a target don't appear. A few rows only, one per target.
    """
    joined = targets.select("source", "target_share", "max_copies").join(sizes, "source", "left").fillna(0, ["n_docs", "source_tokens"])
    usable = F.when((F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_copies") > 0), F.col("max_copies") * F.col("source_tokens") / F.col("target_share"))
    everything = Window.partitionBy(F.lit(1))
    size = F.lit(float(total)) if total is not None else F.min("__most").over(everything)
    out = joined.withColumn("__most", usable).withColumn("__size", size)
    quota = F.when(F.col("__most").isNotNull(), F.least(F.col("__size"), F.col("__most")) * F.col("target_share")).otherwise(0.0)
    return out.withColumn("quota", quota).withColumn("limits", F.coalesce(F.col("__most") <= F.col("__size"), F.lit(False))).withColumnRenamed("__most", "most_total").drop("__size")


def levels_of(docs: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per source ``rate`` and ``rest``: a document of weight w is due least(max_copies, rate * w) copies, which adds up to the quota in tokens.

    docs: ``source``, ``__w``, ``n_tokens``. The rate is found on the few different weights of a source: those from the
    largest down to some weight are due the most copies, and the others what is left in proportion; the first place where
    no other exceeds the cap is it. ``rest`` is the quota without whole copies: the tokens to be drawn.
    """
    levels = docs.groupBy("source", "__w").agg(F.sum("n_tokens").alias("__t")).join(F.broadcast(quotas.filter("quota > 0").select("source", "quota", "max_copies")), "source")
    down = Window.partitionBy("source").orderBy(F.desc("__w"))
    above = F.coalesce(F.sum("__t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("__t") * F.col("__w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.try_divide(F.col("quota") - F.col("max_copies") * above, below)
    levels = levels.withColumn("__rate", rate).withColumn("__fits", F.col("__rate") * F.col("__w") <= F.col("max_copies") * (1 + 1e-9))
    levels = levels.withColumn("rate", F.max_by("__rate", F.when(F.col("__fits"), F.col("__w"))).over(Window.partitionBy("source")))
    whole = F.sum(F.col("__t") * whole_copies(due(F.col("__w"))))
    return levels.groupBy("source", "max_copies", "rate").agg((F.first("quota") - whole).alias("rest"))


def due(weight: Column) -> Column:
    """Copies that a document is due, whole and in part; all it may have where no rate fits below the cap."""
    return F.when(weight > 0, F.least(F.coalesce(F.col("rate") * weight, F.col("max_copies")), F.col("max_copies"))).otherwise(0.0)


def whole_copies(copies: Column) -> Column:
    """A number that is whole but for rounding is that number."""
    return F.floor(copies + 1e-9).cast("int")


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Returns (mix, shares) from ``docs`` (``key``, ``source``, ``n_tokens``, optionally ``weight``) and ``targets``.

    mix: ``doc_id``, ``source``, ``n_tokens``, ``copies`` of the documents taken at least once. shares: per target source
    ``target_share``, ``max_copies``, ``n_docs``, ``taken_docs``, ``taken_copies``, ``tokens``, ``quota``, ``actual_share``,
    and ``most_total`` and ``limits`` of allocate.

    Within a source a document is due copies in proportion to its weight, up to ``max_copies``, so that all dues add up to
    the quota. Its whole copies are certain; the rest of its due is its probability p of one copy more, which is drawn in
    Pareto order: with a random number u, documents rank by (u/(1-u)) / (p/(1-p)), and are taken in that order while the
    drawn tokens stay within the rest of the quota. The total is thus fixed up to one document. A null weight counts as 1,
    one of 0 or less is never taken; no weights: all are alike.

    No source is sorted as a whole: running totals are taken over BINS bins of the rank, which one partial aggregation
    fills, and only the one bin per source in which the quota ends is ordered by rank and id. Documents with null or no
    tokens, without source or of a source without target are not taken. Repeated keys are separate documents with one rank.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in docs.columns else F.lit(1.0)
    stepped = F.when(weight > 0, F.pow(F.lit(2.0), F.round(F.log2(weight) * STEPS) / STEPS)).otherwise(0.0)
    docs = docs.filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).select(F.col(key).alias("doc_id"), "source", "n_tokens", stepped.alias("__w"))
    sizes = docs.filter("__w > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    # one row per target source: as many as the caller's table of targets has, which is a table of settings
    quotas = cut_lineage(allocate(sizes, targets, total))
    plan = cut_lineage(levels_of(docs.filter("__w > 0"), quotas))
    copies = due(F.col("__w"))
    ranked = docs.join(F.broadcast(plan), "source").withColumn("whole", whole_copies(copies)).withColumn("__p", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    p = F.least(F.col("__p"), F.lit(1 - 1e-9))
    u = uniform(F.col("doc_id"), seed)
    ranked = ranked.withColumn("__q", F.when(p > 1e-9, (u / (1 - u)) / (p / (1 - p)))).withColumnRenamed("rest", "__rest")
    ranked = ranked.withColumn("__bin", F.least(F.floor(F.col("__q") / (1 + F.col("__q")) * BINS), F.lit(BINS - 1)).cast("int"))
    drawable = F.col("__q").isNotNull() & (F.col("whole") < F.col("max_copies"))
    ranked = ranked.withColumn("__drawable", drawable)
    bins = ranked.filter("__drawable").groupBy("source", "__bin").agg(F.sum("n_tokens").alias("__tokens"), F.first("__rest").alias("__rest"))
    running = F.sum("__tokens").over(Window.partitionBy("source").orderBy("__bin"))
    # at most BINS rows per target source
    bins = bins.withColumn("__before", running - F.col("__tokens")).select("source", F.col("__bin"), "__before", (F.col("__before") + F.col("__tokens") <= F.col("__rest")).alias("__all"))
    edge = bins.filter(~F.col("__all")).groupBy("source").agg(F.min("__bin").alias("__edge"), F.min("__before").alias("__before"))
    ranked = ranked.join(F.broadcast(edge), "source", "left")
    in_edge = F.col("__drawable") & (F.col("__bin") == F.col("__edge"))
    within = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("__q", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = ranked.filter(in_edge).withColumn("__drawn", (F.col("__before") + within <= F.col("__rest")).cast("int"))
    outside = ranked.filter(~F.coalesce(in_edge, F.lit(False)))
    outside = outside.withColumn("__drawn", (F.col("__drawable") & (F.col("__edge").isNull() | (F.col("__bin") < F.col("__edge")))).cast("int"))
    mix = outside.unionByName(at_edge).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("__drawn")).alias("copies")).filter("copies > 0")
    taken = mix.groupBy("source").agg(F.count(F.lit(1)).alias("taken_docs"), F.sum("copies").alias("taken_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    shares = quotas.join(F.broadcast(taken), "source", "left").fillna(0, ["taken_docs", "taken_copies", "tokens"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0))
    return mix, shares.select("source", "target_share", "max_copies", "n_docs", "source_tokens", "taken_docs", "taken_copies", "tokens", "quota", "actual_share", "most_total", "limits")


def sized_documents(documents: DataFrame, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``weight`` of every document, encoded once and cut from its lineage: later steps read narrow columns.

    The weight is the number of tokens: the probability of being drawn is proportional to size.
    """
    return cut_lineage(token_counts(documents, ["doc_id", "source"], name=name, directory=directory)).withColumn("weight", F.col("n_tokens"))
