"""Helpers that several operators share: the shared folder, written tables, batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.operators.shared import small
from tessera.operators.shared import shared_folder as shared_dir
from tessera.operators.shared import written as stash

__all__ = ["SPACE", "hash_sample", "is_held_out", "map_texts", "numbered", "one_space", "shared_dir", "small", "stash", "text_batches", "words"]

#: The words of every operator here: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def one_space(text):
    """The text with every white space character as a space, by plain replacements."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text):
    """The words of a text column; null for null. A single character is split at without a regular expression."""
    return F.array_remove(F.split(one_space(text), " "), "")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``: _number, unlike for all rows and the same whenever it is read, and the whole row as _doc.

    Ids may be shared or missing; what is decided of a row is joined to it by its number: the file it stands in
    and its place there. Files that were read as they are need no copy; other rows are written first.
    """
    as_read = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "_metadata") if as_read and "_metadata" not in docs.columns else None
    if rows is None:
        rows = stash(docs.select(F.struct(*docs.columns).alias("_doc")), name).select("_doc", "_metadata")
    return rows.select("_doc", F.struct(F.md5(F.col("_metadata.file_path").cast("binary")).alias("file"), F.col("_metadata.row_index").alias("row")).alias("_number"))


def hash_sample(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, id): at most ``limit`` ids of each group, those that hash lowest; repeated ones count once.

    Groups must be few. Approximate numbers of distinct ids give each a share of the hashes that holds more than
    twice the limit on average (50 more than that, so that small limits are reached too), so that only about as
    many ids are ranked, however large the group and however often an id is repeated.
    """
    wanted = 2.0 * limit + 50
    share = small(rows.groupBy(group).agg((wanted / F.approx_count_distinct("id")).alias("_share")), "sample-shares")
    near = rows.join(share, group).where(F.xxhash64("id") / 2.0**64 + 0.5 < F.col("_share")).select(group, "id").distinct()
    order = Window.partitionBy(group).orderBy(F.xxhash64("id"), "id")
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def text_batches(texts, limit: int = 4_000_000):
    """Split a column of texts into runs of about ``limit`` characters: (first row, texts).

    Nulls become empty texts. A longer text makes a run of its own, never a shorter text.
    """
    run, size, start = [], 0, 0
    for k, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield start, run
            run, size, start = [], 0, k
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def map_texts(docs: DataFrame, keep: list[Column], text: Column, made: str, work: Callable[[list[str]], list[pa.Array]], limit: int = 2_000_000) -> DataFrame:
    """Columns ``keep`` of ``docs`` as they are, and columns ``made`` (DDL) that ``work`` makes of runs of texts.

    What is kept passes as Arrow, so integers beside nulls stay exact. Null texts come as empty ones.
    """
    source = docs.select(*keep, text.alias("_text"))
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL(made).fields])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = [work(texts) for _, texts in text_batches(batch.column(batch.num_columns - 1).to_pylist(), limit)]
                columns = [pa.concat_arrays(list(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def is_held_out(doc_id):
    """crc32 of the id's decimal text, mod 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
