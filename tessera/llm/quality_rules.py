"""Quality rules: base rules, then robust multivariate outliers per language and source.

All of it is DataFrame expressions. The statistics of each text are made once, inside its row, and
written; what follows works on a few numbers a document. Each group's location and scatter come from
the minimum covariance determinant, regularised by a floor on each scale: from four deterministic
starts, concentration steps re-estimate both from the share of documents with the smallest
Mahalanobis distances until the determinant stops falling; the core with the least one wins and is
reweighted. Quantiles are read off counts in fixed bins, which any number of tasks can add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import numbered, one_space, stash
from tessera.operators.shared import FEW_ROWS, observed

#: The share of documents that a core has, and that reweighting would keep of a normal distribution.
SHARE, WEIGHED = 0.75, 0.975
#: Concentration steps at most, and those that all starts take; determinants stop falling much earlier.
STEPS, EARLY = 100, 1
#: Bins of the distance for each e-fold of it.
BINS = 256
#: A determinant that falls by less than this share of itself falls no more: sums differ by so much with their order.
SETTLED = 1e-9
#: Groups need so many documents for estimates of their own; pools of what is left need fewer.
LEAST, ENOUGH = 60, 10
#: Rates of short texts lean on the group's typical rate as if there were so many more words.
PRIOR = 100
#: Scale below which a difference in each transformed statistic means nothing (added to the scatter).
FLOOR = (0.05, 0.25, 0.3, 0.5)
#: A document is rejected if so rare under the estimates.
TAIL = 1e-6
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_P = len(FLOOR)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _upper(x: float, half: int) -> float:
    """P(chi-square > x) for 2 * half degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _quantile(tail: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _upper(mid, half) > tail else (low, mid)
    return low


#: Make the scatter of the central share, and of the reweighted one, consistent with that of a normal distribution.
CONSISTENT, REWEIGHTED = (share / (1 - _upper(_quantile(1 - share, _P // 2), _P // 2 + 1)) for share in (SHARE, WEIGHED))
CUTOFF = _quantile(TAIL, _P // 2)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) in place of the text.

    A null text has no words. All expressions stay in the row: no text is shuffled or exploded.
    """
    keep = [c for c in docs.columns if c != text_col]
    d = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).drop(text_col)
    d = d.withColumn("_flat", one_space(F.col("_text"))).withColumn("_words", F.array_remove(F.split("_flat", " "), ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    d = d.withColumn("_n", F.size("_words"))
    # half a hash of each 3-word window above its place, sorted as numbers: places that share the half hash may hold equal windows
    d = d.withColumn("_hashed", F.expr("if(_n < 4, null, sort_array(transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), 32) + i)))"))
    near = "shiftright(x, 32) = shiftright(get(_hashed, i {0} 1), 32)"
    d = d.withColumn("_maybe", F.expr(f"transform(filter(_hashed, (x, i) -> {near.format('-')} or {near.format('+')}), x -> int(x & 4294967295))"))
    # of those, the windows themselves, sorted: equal ones stand side by side
    d = d.withColumn("_sorted", F.expr("sort_array(transform(_maybe, p -> struct(_words[p] as a, _words[p + 1] as b, _words[p + 2] as c, p as p)))"))
    same = "(x.a = get(_sorted, i {0} 1).a and x.b = get(_sorted, i {0} 1).b and x.c = get(_sorted, i {0} 1).c)"
    d = d.withColumn("_twice", F.expr(f"transform(filter(_sorted, (x, i) -> {same.format('-')} or {same.format('+')}), x -> x.p)"))
    without = F.col("_text")
    for c in SYMBOLS:
        without = F.replace(without, F.lit(c), F.lit(""))
    return d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.replace("_flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(without)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr("size(array_distinct(flatten(transform(_twice, x -> array(x, x + 1, x + 2)))))"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _marked(table: DataFrame, few: bool) -> DataFrame:
    """A table of a row for each group and start, for broadcast where the groups were counted and are few."""
    return F.broadcast(table) if few else table


def _grouped(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Adds _group: language and source, or all small groups of a language, or what is still small of all languages; are they few?"""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = rows.withColumns({"_lang": name("_lang0"), "_pair": F.concat(name("_lang0"), F.lit("\x1f"), name("_source0"))})
    pairs = rows.groupBy("_pair", "_lang").agg(F.count(F.lit(1)).alias("n")).withColumn("wide", F.when(F.col("n") >= LEAST, F.col("_pair")))
    of_lang = F.sum(F.when(F.col("wide").isNull(), F.col("n"))).over(Window.partitionBy("_lang"))
    names = pairs.select("_pair", F.coalesce("wide", F.when(of_lang >= LEAST, F.concat("_lang", F.lit("\x1f*"))), F.lit("*")).alias("_group"))
    names, seen = observed(names, "quality-names", n=F.count(F.lit(1)))
    few = 4 * seen["n"] <= FEW_ROWS
    return rows.join(_marked(names, few), "_pair").drop("_pair", "_lang"), few


def _factors(estimates: DataFrame) -> DataFrame:
    """(_group, _start, _was, m_i, L_i_j, log_det): each estimate's location, and the Cholesky factor and determinant of its scatter."""
    for i, j in _PAIRS:
        rest = F.col(f"s_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"L_{i}_{k}") * F.col(f"L_{j}_{k}")
        estimates = estimates.withColumn(f"L_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"L_{j}_{j}"))
    log_det = 2 * sum((F.log(f"L_{i}_{i}") for i in range(1, _P)), F.log("L_0_0"))
    kept = [f"m_{i}" for i in range(_P)] + [f"L_{i}_{j}" for i, j in _PAIRS]
    return estimates.select("_group", "_start", "_was", *kept, log_det.alias("log_det"))


def _measured(rows: DataFrame, factors: DataFrame, how: str = "inner") -> DataFrame:
    """Adds _start, its _was (log_det) and _d2, the squared Mahalanobis distance, by forward substitution; a row for each start of the group."""
    out = rows.join(factors.drop("_was"), "_group", how)
    for i in range(_P):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"L_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", rest / F.col(f"L_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, _P)), F.col("z_0") * F.col("z_0"))
    return out.select(*rows.columns, "_start", F.col("log_det").alias("_was"), total.alias("_d2"))


def _binned_quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """(keys, total, <share>_<value>): the bins in which each share of each value is reached.

    Only counts of bins are shuffled, for all values in one go; the rows stay where they are.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), v.cast("long").alias("bin")) for k, v in values.items()]))
    counts = rows.select(*keys, bins.alias("b")).groupBy(*keys, "b.of", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(*keys, "of")
    counts = counts.withColumns({"upto": F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(one)})
    first = lambda k, share: F.min(F.when((F.col("of") == k) & (F.col("upto") >= share * F.col("total")), F.col("bin")))
    return counts.groupBy(*keys).agg(F.max("total").alias("total"), *[first(k, share).alias(f"{name}_{k}") for k in values for name, share in shares.items()])


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """(_group, _start, _was, m_i, s_i_j): means and covariances, these times ``scale`` and with the floors added."""
    sums = rows.groupBy("_group", "_start").agg(F.first("_was").alias("_was"), *[F.avg(f"x_{i}").alias(f"m_{i}") for i in range(_P)], *[F.covar_pop(f"x_{i}", f"x_{j}").alias(f"c_{i}_{j}") for i, j in _PAIRS])
    return sums.select("_group", "_start", "_was", *[f"m_{i}" for i in range(_P)], *[(F.col(f"c_{i}_{j}") * scale + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}") for i, j in _PAIRS])


def starts(judged: DataFrame, few: bool) -> DataFrame:
    """(_group, _start, m_i, s_i_j): medians, quartiles below and above, each with median deviations; means with covariances."""
    axes = [f"x_{i}" for i in range(_P)]
    bins = {x: F.floor(F.col(x) / (floor / 10)) for x, floor in zip(axes, FLOOR, strict=True)}
    found = _binned_quantiles(judged, ["_group"], bins, {"low": 0.25, "mid": 0.5, "top": 0.75}).where(F.col("total") >= ENOUGH)
    found = found.select("_group", *[((F.col(f"{q}_{x}") + 0.5) * (floor / 10)).alias(f"{q}_{x}") for q in ("low", "mid", "top") for x, floor in zip(axes, FLOOR, strict=True)])
    found = stash(found, "quality-start")
    off = {x: F.floor(F.abs(F.col(x) - F.col(f"mid_{x}")) / (floor / 10)) for x, floor in zip(axes, FLOOR, strict=True)}
    spread = _binned_quantiles(judged.join(_marked(found, few), "_group"), ["_group"], off, {"mad": 0.5}).drop("total")
    scatter = [(F.pow((F.col(f"mad_{axes[i]}") + 0.5) * (FLOOR[i] / 10) * 1.4826, 2) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    three = F.explode(F.array(*[F.struct(F.lit(k).alias("_start"), *[F.col(f"{q}_{x}").alias(f"m_{i}") for i, x in enumerate(axes)]) for k, q in enumerate(("mid", "low", "top"))])).alias("at")
    # tables of a row for each group meet by sorting, as every broadcast takes some MB of the driver whatever its size
    robust = spread.join(found.hint("merge"), "_group").select("_group", three, *scatter).select("_group", "at.*", F.lit(None).cast("double").alias("_was"), *[f"s_{i}_{j}" for i, j in _PAIRS])
    plain = _moments(judged.withColumns({"_start": F.lit(3), "_was": F.lit(None).cast("double")}), 1.0).join(found.select("_group").hint("merge"), "_group")
    return robust.unionByName(plain)


def concentrated(judged: DataFrame, factors: DataFrame, few: bool) -> DataFrame:
    """The factors after one step, from the moments of the SHARE of documents with the smallest distances; falls: log_det before less after.

    The documents are read once: each bin of the distance keeps its number and moments, and those of the
    bins up to the cut are added up, of the last one only the part that is wanted, so that all cores of a
    group weigh the same.
    """
    keys, axes = ["_group", "_start"], range(_P)
    place = F.floor(F.log(F.col("_d2") + 1e-6) * BINS)
    sums = {"n": F.count(F.lit(1))} | {f"a_{i}": F.sum(f"x_{i}") for i in axes} | {f"b_{i}_{j}": F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")) for i, j in _PAIRS}
    bins = _measured(judged, _marked(factors, few)).groupBy(*keys, place.alias("bin")).agg(F.first("_was").alias("_was"), *[v.alias(k) for k, v in sums.items()])
    one = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = (SHARE * F.sum("n").over(one) - below) / F.col("n")
    core = bins.withColumn("part", F.least(part, F.lit(1.0))).where("part > 0")
    core = core.groupBy(*keys).agg(F.first("_was").alias("_was"), *[F.sum(F.col(k) * F.col("part")).alias(k) for k in sums])
    mean = {i: F.col(f"a_{i}") / F.col("n") for i in axes}
    spread = {(i, j): CONSISTENT * (F.col(f"b_{i}_{j}") / F.col("n") - mean[i] * mean[j]) + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    after = _factors(core.select(*keys, "_was", *[mean[i].alias(f"m_{i}") for i in axes], *[v.alias(f"s_{i}_{j}") for (i, j), v in spread.items()]))
    return after.withColumn("falls", F.col("_was") - F.col("log_det"))


def least_determinant(judged: DataFrame, few: bool = True) -> DataFrame:
    """The factors of each group's core with the least determinant, over all starts.

    ``judged`` has _group and x_i; ``few`` says that a row for each group may be broadcast. After EARLY
    steps only each group's two best starts go on; each goes on until its determinant falls no more.
    """
    best = lambda cores, n: cores.withColumn("_best", F.row_number().over(Window.partitionBy("_group").orderBy("log_det", "_start"))).where(F.col("_best") <= n).drop("_best")
    factors = stash(_factors(starts(judged, few)), "quality-factors")
    found = None
    for step in range(1, STEPS + 1):
        after = concentrated(judged, factors, few)
        after = best(after, 2) if step == EARLY else after
        moving = F.lit(step <= EARLY) | (F.col("falls") > SETTLED) & F.lit(step < STEPS)
        after, seen = observed(after.withColumn("moving", moving), "quality-factors", moving=F.count_if(F.col("moving")))
        cores = after.drop("falls", "moving")
        found = cores if found is None else found.unionByName(cores)
        factors = after.where("moving").drop("falls", "moving")
        if not seen["moving"]:
            break
    return best(found, 1)


def outliers(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``stats`` (from text_statistics) with distance2, the squared robust distance within the group.

    The estimates are reweighted: location and scatter of all documents that are not unlikely under the
    core of least determinant. distance2 is null for documents that fail the base rules, which take no
    part in estimates, and where the last pool has fewer than ENOUGH documents.
    """
    rows = stats.withColumns({"_lang0": F.col(lang_col), "_source0": F.col(source_col)})
    judged, few = _grouped(rows.where("not base_failed").select("_row", "_lang0", "_source0", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    length = F.floor(F.log(F.col("word_chars") / F.col("n_words")) * 200)
    typical = _binned_quantiles(judged, ["_group"], {"length": length}, {"typical": 0.5}).drop("total")
    rate = lambda c: F.log1p(100 * F.col(c) / (F.col("n_words") + PRIOR))
    level = F.exp((F.col("typical_length") + 0.5) / 200)
    judged = judged.join(_marked(typical, few), "_group").select(
        "_row", "_group", F.log((F.col("word_chars") + PRIOR * level) / (F.col("n_words") + PRIOR)).alias("x_0"), rate("n_symbols").alias("x_1"), rate("n_dup_lines").alias("x_2"), rate("n_repeat_words").alias("x_3")
    )
    judged = stash(judged, "quality-vectors")
    core = _measured(judged, _marked(least_determinant(judged, few), few)).where(F.col("_d2") <= _quantile(1 - WEIGHED, _P // 2))
    final = stash(_factors(_moments(core, REWEIGHTED)), "quality-final")
    final = _measured(judged, _marked(final, few), "left").select("_row", F.col("_d2").alias("distance2"))
    return rows.drop("_lang0", "_source0").join(final, "_row", "left")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: its columns but the text, the statistics, base_failed, distance2, kept.

    kept is false if base_failed (under 50 words, or over half of the words in repeated 3-word
    windows), else false only if distance2 exceeds the cut-off. Groups of fewer than LEAST documents
    are judged with the others of their language, or then with those of all languages, or, if these
    are fewer than ENOUGH, by the base rules alone. Null languages and sources are groups of their own; null texts have no words and fail; an empty table gives an empty
    result. Rows with null or repeated ids are judged like any other; columns of ``docs`` with the
    name of a result keep out of it.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]
    bare = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang_"), F.col(source_col).alias("_source_"), F.col(text_col).alias("_text_"))
    stats = text_statistics(bare, "_text_").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = stash(stats.withColumn("_row", F.monotonically_increasing_id()), "quality-statistics")
    judged = outliers(stats, "_lang_", "_source_").withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF))
    return judged.select(F.col("_id").alias(id_col), *made)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns; each is judged by itself, whatever its id."""
    rows = numbered(docs, "quality-rows")
    verdict = quality_rules(rows.select("_number", "_doc.text", "_doc.lang", "_doc.source"), id_col="_number").where("kept").select("_number")
    return rows.join(verdict, "_number", "left_semi").select("_doc.*")
