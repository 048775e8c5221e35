"""Mixing sources to target weights by Pareto order sampling.

Targets come from weights by water-filling. Each document should appear e times on average; the
whole part of e is allocated as certain copies. For the rest p of it, documents are ranked by random
odds over inclusion odds, u/(1-u) / (p/(1-p)), and the first ones are taken until the source's
remaining words are used up. The running sum is made in two levels, by bins of the rank and then
inside each bin, so no source has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small, stash, words

#: Weights of the sources in order, repeating; the share of all words to take; most copies of a document.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Bins for each doubling of a rank; levels of leaning for each doubling.
BINS, STEPS = 64, 8
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words of each text: what stands between white space; a null text has none."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), by water-filling.

    Sources in code point order, nulls last, take ``weights`` in turn. A source that would exceed
    ``most`` times its size stops there; the excess is shared again by weight until none is above.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * float(most))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"all": F.sum("source_size").over(every) * float(total), "all_w": F.sum("w").over(every), "less": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "less_w": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("all") - F.col("less")) / (F.col("all_w") - F.col("less_w")))
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("full") / F.col("w"), F.col("level"))).over(every))
    share = F.least(F.col("full"), F.coalesce("water", F.lit(0.0)) * F.col("w"))
    return s.select("source", "source_size", F.when(F.col("water").isNull(), F.col("full")).otherwise(share).alias("target"))


def middling(size: Column) -> Column:
    """The leaning of the registered query: texts of 100 to 1000 words are twice as likely as others of their source."""
    return F.when(size.between(100, 1000), 2.0).otherwise(1.0)


def expectations(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, level, source_size, target, e, sure) from (source, level, words): expected copies at each level of leaning.

    Within a source, e follows 2 ** (level / STEPS), is at most ``most``, and meets the target: levels
    that reach ``most`` stop there and the others share what is left. sure: words of whole copies.
    """
    goal = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
    s = sizes.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    s = s.withColumn("lean", F.pow(F.lit(2.0), F.col("level") / float(STEPS)))
    down = Window.partitionBy("source").orderBy(F.desc("level"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    rest = F.sum(F.col("words") * F.col("lean")).over(down.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("factor", F.when(rest > 0, (F.col("target") - above) / rest))
    fits = F.when(F.col("factor") * F.col("lean") <= float(most), F.struct("level", "factor"))
    s = s.withColumn("factor", F.max(fits).over(Window.partitionBy("source"))["factor"])
    s = s.withColumn("e", F.coalesce(F.least(F.lit(float(most)), F.col("factor") * F.col("lean")), F.lit(float(most))))
    sure = F.sum(F.floor("e") * F.col("words")).over(Window.partitionBy("source"))
    return s.select("source", "level", "source_size", "target", "e", sure.alias("sure"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total: float = TOTAL,
    most: int = MOST,
    seed: str = SEED,
    leaning: Callable[[Column], Column] | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken (words the mix takes).

    ``leaning`` makes of a document's size a positive factor of its inclusion within its source
    (default: alike), in steps of 1 / STEPS of its binary logarithm, from 2**-16 to 2**16; expected copies
    follow it, at most ``most``. Random numbers come from the id and ``seed`` alone, so reruns agree. A
    null source is a source of its own; null and empty texts have size 0 and are never taken; null ids
    draw as one id; repeated rows are ranked one after the other; an empty table gives an empty result;
    other columns are not read. ``row_col``, a column unlike for all rows, is carried along, and orders
    rows of one id and size.
    """
    row = [] if row_col is None else ["_of"]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *[F.col(row_col).alias(c) for c in row])
    lean = F.lit(1.0) if leaning is None else leaning(F.col("size")).cast("double")
    d = d.withColumn("level", F.greatest(F.lit(-16 * STEPS), F.least(F.lit(16 * STEPS), F.rint(F.log2(lean) * STEPS))).cast("int"))
    d = stash(d, "mix-sizes")  # the texts are read once
    sizes = stash(d.groupBy("source", "level").agg(F.sum("size").alias("words")), "mix-levels")
    plan = small(expectations(sizes, weights, total, most).select(F.col("source").alias("to"), F.col("level").alias("to_level"), "source_size", "target", "e", "sure"), "mix-plan")
    d = d.join(plan, d["source"].eqNullSafe(plan["to"]) & (d["level"] == plan["to_level"])).drop("to", "to_level", "level")
    d = d.withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("certain"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    d = d.withColumn("u", (drawn + 0.5) / float(2**52))
    d = d.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    drawing = (F.col("p") > 0) & (F.col("size") > 0)
    # the log of a rank follows the logistic law, so no bin of it holds more than 1 in 300 of a source's rows
    ranked = d.where(drawing).withColumn("bin", F.floor(F.log2("rank") * BINS).cast("int"))
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("inside"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = small(sums.select(F.col("source").alias("to"), F.col("bin").alias("to_bin"), F.coalesce(F.sum("inside").over(upto), F.lit(0)).alias("before_bin")), "mix-bins")
    ranked = ranked.join(sums, ranked["source"].eqNullSafe(sums["to"]) & (ranked["bin"] == sums["to_bin"]))
    inside = Window.partitionBy("source", "bin").orderBy("rank", "id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_bin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ranked = ranked.withColumn("copies", F.col("certain") + (before + F.col("size") / 2.0 <= F.col("target") - F.col("sure")).cast("long"))
    rest = d.where(~drawing).withColumn("copies", F.when(F.col("size") > 0, F.col("certain")).otherwise(F.lit(0).cast("long")))
    made = ["id", "size", "source_size", "target", "copies", *row]
    out = ranked.select(made).unionByName(rest.select(made))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", *[F.col(c).alias(row_col) for c in row]).withColumn("taken", F.col("copies") * F.col("size"))
