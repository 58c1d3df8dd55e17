"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, fresh, stage

#: Bins of each of the two levels of the distributed prefix sum.
BINS = 256
#: Between these are the logarithms of keys of all weights that a double can be, from 1e-6 on.
LOW, HIGH = -750.0, 20.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column, size: Column) -> Column:
    """A cheap quality weight in (0, 1]: 1 at six characters a word, falling on both sides."""
    mean = F.length(text.cast("string")).cast("double") / size
    return F.when(size > 0, 1.0 / (1.0 + F.abs(mean - 6.0) / 6.0)).otherwise(F.lit(1.0))


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id: reruns agree."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def key_bin(key: Column) -> Column:
    """The bin of a key: equal steps of its logarithm. The logarithm of a key is spread alike for every
    weight, only moved by it, so a bin holds less than half a hundredth of the rows of a weight."""
    place = (F.greatest(F.log(key), F.lit(LOW)) - LOW) / (HIGH - LOW)
    return F.least(F.floor(place * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")


def source_targets(sizes: DataFrame, ratios: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, target: the sources by code point, null last, get ``ratios`` in turn.

    ``share`` of all words are dealt by ratio; no source gets more than ``cap`` times its size.
    With the sources in the order in which they reach their cap, the level is the first one
    at which the next source stays below it. The rows here are sources, not documents.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.element_at(F.array(*[F.lit(int(r)) for r in ratios]), ((F.row_number().over(order) - 1) % len(ratios) + 1).cast("int"))
    src = src.withColumn("ratio", ratio).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_limit = Window.orderBy(F.col("limit") / F.col("ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    src = (
        src.withColumn("before", F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))
        .withColumn("ratio_left", F.sum("ratio").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("before")) / F.col("ratio_left"))
        .withColumn("open", F.col("limit") / F.col("ratio") > F.col("level"))
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("ratio"), "level"))).over(everything)["level"]
    dealt = F.coalesce(F.least(F.col("limit"), level * F.col("ratio")), F.col("limit"))
    return src.withColumn("target", dealt).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight: Column | None = None,
    ratios: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, epochs, taken, sample_key.

    Size is the number of words (null text: 0). A source's target buys complete epochs first;
    what is left is filled with the documents that have the smallest exponential keys, up to
    the word budget. The last document is in if that brings the source nearer to its target,
    so a source misses its target by half a document at most, repeated rows included. ``weight`` (positive, over the
    columns of docs) scales the keys; by default it is prose_weight. A null or non-positive
    weight counts as the smallest, 1e-6.

    Sizes per source and key bin are added up first; only the bin in which a source's budget
    ends is split again, and only the documents of one bin in 65,536 are sorted. A source that
    holds a third of all rows is therefore never sorted in one task.

    Null ids and null sources are ordinary values. Rows that repeat an id share its key; of
    these, the smaller sizes come first, and rows equal in that as well are told apart by their place
    in the staged table. Texts of any length count whole; an empty table gives no rows.
    """
    row = fresh(docs, "_row")
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    return _plan(docs, row, id_col, source_col, text_col, weight, ratios, share, cap, seed).drop("row")


def _plan(docs: DataFrame, row: str, id_col: str, source_col: str, text_col: str, weight: Column | None, ratios: Sequence[int], share: float, cap: float, seed: int) -> DataFrame:
    """What mix gives, and the row's identity as ``row``."""
    size = word_count(F.col(text_col))
    w = prose_weight(F.col(text_col), F.col("size")) if weight is None else weight
    wide = docs.withColumn(fresh(docs, "size"), size) if weight is not None else docs
    if weight is None:
        base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), size.alias("size"), F.col(row).alias("row"))
        base = base.withColumn("weight", w)
    else:
        base = wide.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("weight"), F.col(row).alias("row"))
    safe = F.when(F.col("weight") > 1e-6, F.col("weight")).otherwise(F.lit(1e-6))
    base = base.select("id", "source", "size", "row", exponential_key(F.col("id"), safe, seed).alias("sample_key"))
    base = stage(base.withColumn("fine", key_bin(F.col("sample_key"))).withColumn("coarse", (F.col("fine") / BINS).cast("int")), "sizes")

    src = source_targets(base, ratios, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    src = src.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    src = stage(src, "sources")

    def boundary(rows: DataFrame, bin_col: str) -> DataFrame:
        """source, bin and words before it: the bin in which the budget ends."""
        sums = rows.groupBy("source", bin_col, "rest", "before").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
        end = F.col("before") + F.sum("words").over(run)
        sums = sums.withColumn("end", end).withColumn("start", F.col("end") - F.col("words"))
        ends = (F.col("start") < F.col("rest")) & (F.col("end") >= F.col("rest"))
        return sums.filter(ends).select("source", bin_col, "rest", F.col("start").alias("before"))

    def within(bins: DataFrame, bin_col: str) -> DataFrame:
        b = bins.select(F.col("source").alias("s"), F.col(bin_col).alias("b"), "rest", "before")
        return base.join(b, base["source"].eqNullSafe(F.col("s")) & (base[bin_col] == F.col("b"))).drop("s", "b")

    open_src = src.filter(F.col("rest") > 0).select("source", "rest")
    coarse_sums = base.groupBy("source", "coarse").agg(F.sum("size").alias("size"))
    coarse_sums = coarse_sums.join(
        open_src.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("before")),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    coarse = boundary(coarse_sums, "coarse")
    last = boundary(within(coarse, "coarse"), "fine")
    order = Window.partitionBy("source").orderBy("sample_key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = within(last, "fine").withColumn("end", F.col("before") + F.sum("size").over(order))
    inside = 2 * F.col("end") - F.col("size") <= 2 * F.col("rest")
    at = F.struct("sample_key", F.col("id").isNotNull().alias("has_id"), "id", "size", "row")
    cuts = edge.groupBy("source", "fine").agg(F.max(F.when(inside, at)).alias("cut"))
    plan = src.join(
        cuts.select(F.col("source").alias("s"), F.col("fine").alias("cut_bin"), "cut"),
        src["source"].eqNullSafe(F.col("s")),
        "left",
    ).drop("s")

    out = attach(base, plan, ["source"], F.xxhash64("row"))
    chosen = (F.col("fine") < F.col("cut_bin")) | ((F.col("fine") == F.col("cut_bin")) & (at <= F.col("cut")))
    taken = F.col("size") * (F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0))
    return out.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "epochs",
        taken.cast("long").alias("taken"),
        "sample_key",
        "row",
    )


def draw(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight: Column | None = None,
    ratios: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The mixed corpus: docs' own rows and columns, each as often as the mix takes it.

    Every row is taken for itself, whether others repeat its id or not: docs are staged with a row
    identity, and the plan is joined on that. Rows without words come as often as their source's epochs."""
    row, key, n = fresh(docs, "_row"), fresh(docs, "_mix_row"), fresh(docs, "_mix_times")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = _plan(docs, row, id_col, source_col, text_col, weight, ratios, share, cap, seed)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.col("epochs")).cast("int")
    plan = plan.select(F.col("row").alias(key), times.alias(n)).filter(F.col(n) > 0)
    joined = docs.join(plan, docs[row] == F.col(key))
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).drop(row, key, n)
