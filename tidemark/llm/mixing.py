"""Mixing sources to target weights by Pareto order sampling.

Targets share a multiple of all words among sources by weight; a source's target stops at MAX_COPIES times its words
and the excess is shared again. Of target / words copies the whole part is certain for every document of a source. The
words left are a sample of unequal probabilities: a document's inclusion probability p is proportional to the square
root of its size (rounded up to a whole number), 1 at most, solved so that the expected words are those left: a long
document carries more connected text, a short one less, but not in proportion. Documents are ranked by random odds over
inclusion odds, u/(1-u) / (p/(1-p)), with u a hash of the id, and taken in that order up to the words that are left (the
sample's size is fixed in words); then one closing document, the one whose size comes nearest to the gap, is taken if
that brings the source nearer to its target.

What p takes is one pass over the sizes: sums by source and root, at most some thousand rows a source.

Ranks of a hot source are never sorted in one task: words are summed in BUCKETS of the rank first, and only the bucket
in which a source's limit falls is ordered. What decides is one small row for each source, joined back by broadcast
where there are at most MAX_BROADCAST sources and by a shuffle (which adaptive execution splits) beyond.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; a null id
hashes as an empty one; rows with equal ids and sizes share one fate within a source; a very long text counts whole, and
is left out of the sample's end if it is longer than what is left there; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
BUCKETS = 4096
MAX_BROADCAST = 100_000
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row for each source: source_size and target. sized has source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    everything = Window.partitionBy()
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumns({"cap": (max_copies * F.col("source_size")).cast("double"), "total": share * F.sum("source_size").over(everything)})
    # Sources fill in the order of cap / weight; one is full if the level that the rest could reach is not below it.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("total") - before) / left)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    level = (F.col("total") - spent) / open_weight
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _attach(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """Null-safe join on source."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    side = per_source.withColumn("_source", key).drop("source")
    if n_sources <= MAX_BROADCAST:
        side = F.broadcast(side)
    return rows.withColumn("_source", key).join(side, "_source", "left").drop("_source")


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, seed: int, *more: Column) -> DataFrame:
    cols = (F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"))
    return docs.select(*more, *cols).withColumn("u", uniform(F.col("doc_id"), seed))


def copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **targets) -> DataFrame:
    """(doc_id, source, size, source_size, target, p, n_copies): how often the mix takes each document, and the probability
    with which it takes one copy more than the certain ones."""
    base = written(_sized(docs, doc_id, source, text, seed), "sizes")
    return _fates(base, base, targets).select("doc_id", "source", "size", "source_size", "target", "p", "n_copies")


def _fates(rows: DataFrame, base: DataFrame, targets: dict) -> DataFrame:
    """rows (as _sized gives them) with n_copies, decided from all of base."""
    plan = written(with_rates(source_targets(base, **targets), base), "targets")
    n_sources = plan.count()
    limits = written(_limits(_ranked(_attach(base, plan, n_sources)), n_sources), "limits")
    return _decided(_attach(_ranked(_attach(rows, plan, n_sources)), limits, n_sources))


def _root(size: Column) -> Column:
    return F.ceil(F.sqrt(size.cast("double"))).cast("long")


def with_rates(plan: DataFrame, sized: DataFrame) -> DataFrame:
    """plan (of source_targets) with certain copies, the words left, and rate: p is rate times the root, 1 at most."""
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(expected).cast("int")).withColumn("left_words", F.col("target") - F.col("certain") * F.col("source_size"))
    sums = sized.where("size > 0").groupBy("source", _root(F.col("size")).alias("root")).agg(F.sum("size").alias("words"))
    # The longest fill up first; a root is full if the rate that the rest could have is not below its own limit, 1 / root.
    order = Window.partitionBy("source").orderBy(F.desc("root"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("root")).over(order.rowsBetween(0, Window.unboundedFollowing))
    sums = _attach(sums.withColumns({"before": before, "rest": rest}), plan.select("source", "left_words"), 0)
    sums = sums.withColumn("full", F.col("rest") <= F.col("root") * (F.col("left_words") - F.col("before")))
    open_ = sums.groupBy("source", "left_words").agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))), F.lit(0)).alias("spent"), F.sum(F.when(~F.col("full"), F.col("words") * F.col("root"))).alias("open"))
    rates = open_.select("source", F.try_divide(F.col("left_words") - F.col("spent"), F.col("open").cast("double")).alias("rate"))
    return _attach(plan, rates, 0)


def _ranked(rows: DataFrame) -> DataFrame:
    """p, and pareto: the rank xi / (1 + xi) of the Pareto variable xi, from 0 (p is 1) to 1 (p is 0)."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("rate"), F.lit(1.0)) * _root(F.col("size"))))
    rows = rows.withColumn("p", F.when((F.col("size") > 0) & (F.col("left_words") > 0), p).otherwise(0.0))
    away, near = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
    return rows.withColumn("pareto", away / (away + near))


def _limits(ranked: DataFrame, n_sources: int) -> DataFrame:
    """For each source the last (pareto, doc_id) taken, and its closing document."""
    rows = ranked.where((F.col("size") > 0) & (F.col("left_words") > 0)).withColumn("bucket", F.when(F.col("p") < 1, F.floor(F.col("pareto") * BUCKETS)).otherwise(-1).cast("int"))
    sums = rows.groupBy("source", "bucket", "left_words").agg(F.sum("size").alias("words"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
    crossing = sums.where((F.col("before") <= F.col("left_words")) & (F.col("before") + F.col("words") > F.col("left_words")))
    crossing = written(crossing.select("source", F.col("bucket").alias("edge"), F.col("before").alias("edge_before")), "edges")
    edge = _attach(rows, crossing, n_sources).where(F.col("bucket") == F.col("edge"))
    edge = edge.groupBy("source", "pareto", "doc_id", "left_words", "edge_before").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("source").orderBy("pareto", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("after", F.col("edge_before") + F.sum("size").over(in_order)).where(F.col("after") <= F.col("left_words"))
    last = edge.groupBy("source").agg(F.max(_here()).alias("last"), F.max("after").alias("taken"))
    # Without a whole document in the crossing bucket, what was taken is all that stands before it.
    last = _attach(crossing, last, n_sources).select("source", F.coalesce("last", F.struct((F.col("edge") / float(BUCKETS)).alias("pareto"), F.lit(-(1 << 63)).alias("doc_id"))).alias("last"), F.coalesce("taken", F.col("edge_before")).alias("taken"))
    last = written(last, "last")
    out = _attach(rows, last, n_sources).where(F.col("last").isNotNull() & ~_within(F.col("last")))
    gap = F.col("left_words") - F.col("taken")
    closing = out.where(F.abs(F.col("size") - gap) < gap).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "pareto", _id())).alias("closing"))
    return _attach(last, closing, n_sources).select("source", "last", F.struct("closing.pareto", "closing.doc_id").alias("closing"))


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")


def _here() -> Column:
    return F.struct(F.col("pareto").alias("pareto"), _id())


def _within(last: Column) -> Column:
    """Not after the last one taken."""
    return _here() <= last


def _decided(rows: DataFrame) -> DataFrame:
    """Sources without a limit take every document's fraction or none: their words left are all or nothing."""
    one_more = F.coalesce(_within(F.col("last")), F.lit(False)) | F.coalesce(_here() == F.col("closing"), F.lit(False))
    one_more = one_more & (F.col("size") > 0) & (F.col("left_words") > 0)
    return rows.withColumn("n_copies", F.when(F.col("size") > 0, F.col("certain") + F.when(one_more, 1).otherwise(0)).otherwise(0))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **targets) -> DataFrame:
    """docs with each row as often as the mix takes it, its columns unchanged. No text is shuffled."""
    base = written(_sized(docs, doc_id, source, text, seed), "sizes")
    rows = _sized(docs, doc_id, source, text, seed, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = _fates(rows, base, targets).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")
