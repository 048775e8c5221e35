"""Which labels of a table of any size stand in which texts.

Every term is known by its anchor: its first ANCHOR characters, or all if it has fewer. Texts are read once; a
bitmap of fixed size tells, without a miss, which of their places can begin an anchor, and only these places, with
as much of the text as the longest term of the table has, meet the terms by their anchor's hash. Equal places of a
text are sent once. What comes of a common anchor is spread by what follows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.candidates import lowered, masked
from tessera.operators.shared import written

ANCHOR = 8
#: Bits of the map of anchors: 2 MB for any number of labels.
BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of that many characters from each place on), for lengths up to ANCHOR."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    held = np.zeros(len(codes), np.uint64)
    for k in range(min(ANCHOR, len(codes))):
        held = _mixed((held[: len(codes) - k] + codes[k:] + np.uint64(1)) * _ODD)
        yield k + 1, held


def anchored(terms: DataFrame) -> DataFrame:
    """``terms`` (label, term) with anchor: the hash of each term's first characters; empty terms are left out."""
    kinds = dict(terms.dtypes)

    def run(frames):
        for frame in frames:
            last = [list(_hashes(t[:ANCHOR]))[-1][1][0] for t in frame["term"]]
            yield frame.assign(anchor=np.array(last, np.uint64).astype(np.int64))

    return terms.where("term <> ''").select("label", "term").mapInPandas(run, f"label {kinds['label']}, term string, anchor long")


def shown(text: str) -> str:
    """A text as labels are looked for in it: without headings and silent sections, in lower case."""
    return lowered(masked(text))


def labels_in(texts: DataFrame, terms: DataFrame, prepare: Callable[[str], str] = shown) -> DataFrame:
    """(doc, label), each once: the labels with a term that stands in a text of ``texts`` (doc, text), as ``prepare`` has it.

    ``terms``: (label, term), terms as they stand in prepared texts. Null texts and terms hold and are nothing.
    """
    spark = texts.sparkSession
    known = written(anchored(terms), "anchored-terms")
    seen = known.agg(F.max(F.length("term")).alias("longest")).first()
    if seen["longest"] is None:
        return texts.join(terms.select("label"), F.lit(False)).select("doc", "label")
    bit = F.shiftrightunsigned("anchor", 64 - BITS) + 1  # bitmaps count from 1
    parts = known.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # 2 MB at most
    flags = np.zeros(1 << BITS, bool)
    for part in parts:
        inside = np.unpackbits(np.frombuffer(bytes(part["bits"]), np.uint8), bitorder="little")
        flags[(part["k"] - 1) * len(inside) + np.flatnonzero(inside)] = True
    shared, longest = spark.sparkContext.broadcast(np.packbits(flags)), seen["longest"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                low = prepare(text or "")
                out: dict[tuple[int, str], None] = {}
                for _, hashes in _hashes(low):
                    for at in np.flatnonzero(held[hashes >> np.uint64(64 - BITS)]).tolist():
                        out[int(hashes[at].astype(np.int64)), low[at : at + longest]] = None
                if out:
                    doc = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(out), np.int64)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([a for a, _ in out], pa.int64()), pa.array([w for _, w in out])], names=["doc", "anchor", "window"])

    places = texts.where("text IS NOT NULL").select("doc", "text").mapInArrow(scan, f"doc {dict(texts.dtypes)['doc']}, anchor long, window string")
    return places.join(known, "anchor").where(F.startswith("window", "term")).select("doc", "label").distinct()
