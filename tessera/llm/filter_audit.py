"""How five filters overlap, for every order they could be applied in, as a stream with retractions.

Documents come as available-now micro-batches of their files. Four filters look at the text alone; the
fifth (a copy of a smaller id's text) depends on what else is there. State keyed by the text's digest keeps
the least id met so far, and how many rows hold it. When a smaller id comes, what was counted for the earlier
holder is retracted and counted again as a copy: each batch appends changes of counters, negative ones too, for
each part and set of failed filters. The counters are their sums, right after any batch; every order and step
is read off them.

State is a table of one narrow row for each text, part and label, written batch by batch in the stream's folder:
a batch appends what it changed, and every SNAPSHOT batches the whole state, so that no batch reads more than
the last snapshot and what came after it. A batch that is done again after a failure overwrites its own folder
and nothing else, so a run that was cut short goes on where it stopped if given its folder.

Rows of one text are counted where they are read before they are shuffled, so a text, an id or a missing id
that a third of all rows hold sends few rows to its task. Everything but the stream's own loop is DataFrame work
in the JVM: Python's keyed state took 5 ms for each text, ten times what reading it takes.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shared_dir, stash, words
from tessera.operators.shared import folder_bytes, remove_folder

#: Each filter by its letter, with its bit.
FILTERS = {letter: 1 << k for k, letter in enumerate("ABCDE")}
COPY = FILTERS["E"]
#: Micro-batches that the files are read in: each takes about this share of all bytes.
BATCHES = 8
#: Every so many batches the whole state is written.
SNAPSHOT = 8
_KEY = ["digest", "mask", "part", "label"]
_STATE = "digest binary, mask int, part string, label int, least long, n long, kept long, copies long"


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; it must not be null."""
    found = words(text)
    fails = {
        "A": F.size(found) < 100,
        "B": 100 * F.size(F.array_distinct(found)) < 80 * F.size(found),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(failed, FILTERS[letter]).otherwise(0) for letter, failed in fails.items()), F.lit(0))


def document_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet file or folder at ``path`` as a stream that takes about 1 / ``batches`` of its bytes at a time."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    share = max(1, folder_bytes(spark, path) // batches)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", share).option("maxFileAge", "36500d").parquet(pattern)


def met(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, mask, part, label, least, n, known, free): the least id of each text, part and label, its rows, all rows with an id, rows without.

    mask: bits of the filters A to D failed; label: 1 for quality = 1, plus 2 for toxic = 1, by any row of
    ``labels`` with the document's id. A null text is an empty one, a null language the part ''.
    """
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask"))
    rows = rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id match no label; they are spread by text instead of meeting in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest").bitwiseOR(F.lit(1))).otherwise(0)
    rows = rows.withColumn("_at", F.coalesce("doc_id", F.lit(0))).withColumn("_null", spread)
    rows = rows.join(told.withColumnRenamed("doc_id", "_at").withColumn("_null", F.lit(0).cast("long")), ["_at", "_null"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    # rows of one id and different parts stay apart; of one id, text and part they are one row by now
    found = rows.groupBy(*_KEY).agg(first.alias("_first"), total(F.col("doc_id").isNotNull()).alias("known"), total(F.col("doc_id").isNull()).alias("free"))
    return found.select(*_KEY, F.col("_first.doc_id").alias("least"), F.col("_first.n").alias("n"), "known", "free")


def merged(state: DataFrame | None, new: DataFrame, whole: bool) -> DataFrame:
    """The state after a batch, with what the batch changes in the counters: rows it touched, or all of them.

    kept and copies are changes: rows that are counted with their own failures, and with E besides. A holder
    that a smaller id of its text displaces gives them back: kept falls, copies rises.
    """
    plain = new.withColumn("_old", F.lit(None).cast("struct<least:long,n:long>")).withColumn("_new", F.struct("least", "n")).select(*_KEY, "_old", "_new", "known", "free")
    if state is not None:
        none = F.lit(None).cast("struct<least:long,n:long>")
        plain = plain.unionByName(state.select(*_KEY, F.struct("least", "n").alias("_old"), none.alias("_new"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("free")))
    both = plain.groupBy(*_KEY).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.sum("known").alias("known"), F.sum("free").alias("free"))
    old, found, least = F.col("_old.least"), F.col("_new.least"), F.least("_old.least", "_new.least")
    held = F.when(old == least, F.col("_old.n")).otherwise(0) + F.when(found == least, F.col("_new.n")).otherwise(0)
    text = Window.partitionBy("digest")
    both = both.select(*_KEY, "_old", least.alias("least"), held.alias("n"), "known", "free", (F.col("_new").isNotNull()).alias("_met"), F.min(old).over(text).alias("_was"), F.min(least).over(text).alias("_is"))
    before = F.when(F.col("_old.least") == F.col("_was"), F.col("_old.n")).otherwise(0)
    now = F.when(F.col("least") == F.col("_is"), F.col("n")).otherwise(0)
    gain = now - before
    out = both.withColumn("kept", gain + F.col("free")).withColumn("copies", F.col("known") - gain)
    if not whole:
        out = out.where("_met OR kept <> 0 OR copies <> 0")
    return out.select(*_KEY, "least", F.when(F.col("least").isNotNull(), F.col("n")).alias("n"), "kept", "copies")


def state_before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """The last row of each text, part and label that the batches before this one wrote, from the last snapshot on."""
    if not batch:
        return None
    since = (batch - 1) // SNAPSHOT * SNAPSHOT
    steps = [spark.read.schema(_STATE).parquet(f"{folder}/state/batch-{k}").withColumn("_batch", F.lit(k)) for k in range(since, batch)]
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    return every.groupBy(*_KEY).agg(F.max_by(F.struct("least", "n"), "_batch").alias("_last")).select(*_KEY, "_last.*").where("least IS NOT NULL")


def counters(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """(part, mask, label, n) after all that the stream gives by now; mask has the bit of E too.

    Rows of a text with equal ids are no copies of one another. A null id is smaller than none and larger than
    none, so it neither is a copy nor makes one, and has no labels. With the same ``folder``, what a run has
    read before isn't read again. An empty table gives no counters.
    """
    spark = docs.sparkSession
    place = folder or f"{shared_dir(spark)}/filter-audit-{uuid.uuid4().hex}"

    def take(rows: DataFrame, batch: int) -> None:
        after = merged(state_before(rows.sparkSession, place, batch), met(rows, labels), whole=batch % SNAPSHOT == 0)
        after.write.mode("overwrite").parquet(f"{place}/state/batch-{batch}")

    query = docs.writeStream.foreachBatch(take).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(f"{place}/state")
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("copies").alias("n"))))
    table = stash(told.select("part", "label", sides.alias("_side")).groupBy("part", F.col("_side.mask").alias("mask"), "label").agg(F.sum("_side.n").alias("n")).where("n <> 0"), "filter-counters")
    if folder is None:
        remove_folder(spark, place)
    return table


def report(counts: DataFrame) -> DataFrame:
    """Every order and step of each part, from its counters: 600 rows a part, zeros included; none without documents.

    A document that fails k filters is removed by each of these in 120 / k of the 120 orders, which gives shapley.
    Counters meet a table of fixed size: what each step of each order makes of each set of failures.
    """
    steps = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for k, letter in enumerate(order):
            own = FILTERS[letter]
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & own), bool(mask & before)
                share = 120 // mask.bit_count() if fails else 0
                steps.append((mask, order, k + 1, *map(int, (not fails and not gone, fails and not gone, fails and gone, mask == own)), share))
            before |= own
    table = counts.sparkSession.createDataFrame(steps, "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, shapley int")
    rows = counts.join(F.broadcast(table), "mask")
    good, toxic = (F.col("label").bitwiseAND(F.lit(bit)) != 0 for bit in (1, 2))

    def total(times: str, of: Column | None = None) -> Column:
        many = F.col("n") * F.col(times)
        return F.sum(many if of is None else F.when(of, many).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        *[total(x).alias(x) for x in ("kept", "removed", "redundant", "unique_fails")],
        total("removed", good).alias("good_lost"),
        total("removed", toxic).alias("toxic_lost"),
        total("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """The whole report of a stream of documents (``document_stream``)."""
    return report(counters(docs, labels, folder))
