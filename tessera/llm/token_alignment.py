"""Which tokens of two tokenizers stand at the same bytes of a text, and how often id pairs do so in a corpus.

Both tokenizers cut the same bytes, so a tokenization is the ascending list of its tokens' end offsets. The
shorter list drives a galloping intersection: each of its ends is looked for in the longer one from where its
predecessor was found, in steps that double, then by halving. Offsets found in both cut the tokens into groups;
differences of the ranks give the tokens of the longer list that each driving token overlaps, its links.

Counts of id pairs come from the whole corpus and go back to the documents by blocks: a task numbers the
distinct pairs of each run of texts once and keeps, for each document, only these numbers and how often each
stands there. Pairs of blocks are counted by a shuffle on the pair; what comes back to a block is one number for
each of its pairs. Neither links nor texts are shuffled, and no table of all pairs is held anywhere.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.llm.common import stash, text_batches
from tessera.llm.pieces import CACHE, Pieces
from tessera.operators.shared import discard

#: Characters of a run of texts whose distinct pairs are numbered together.
RUN = 6_000_000
#: Every so manieth end is looked for first; those between start from where it was found.
STRIDE = 8
SPACE = "▁"
_MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class PlainPieces(Pieces):
    """A byte-level tokenizer to which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.cut, self.special = None, {}


class SpacePieces:
    """A SentencePiece model with a bounded memory of what stands between spaces.

    If no piece has a space after another character, no merge crosses the beginning of a run of spaces, so each
    part from there to the next is encoded alone. Other models, models with a normaliser, and texts that hold
    the space mark itself are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(size)]
        norm = spec.normalizer_spec
        self.split_ok = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lone = self.model.piece_to_id(SPACE)
        self.ids: dict[str, bytes] = {}

    def learn(self, parts) -> None:
        """Encode parts, each a run of spaces and what follows, that aren't in the memory yet."""
        new = [p for p in parts if p not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            new = list(parts)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for p, ids in zip(some, self.model.encode([p[1:] for p in some], num_threads=1), strict=True):
                self.ids[p] = np.array(ids if len(p) > 1 else [self.lone], "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [_PARTS.findall(" " + t) if t and self.split_ok and SPACE not in t else None for t in texts]
        self.learn(dict.fromkeys(p for parts in split if parts for p in parts))
        whole = [np.array(self.model.encode(t, num_threads=1) if t else [], "<u4").tobytes() if parts is None else None for t, parts in zip(texts, split, strict=True)]
        return [b"".join(map(self.ids.__getitem__, parts)) if parts else ids for parts, ids in zip(split, whole, strict=True)]


_PARTS = re.compile(" +[^ ]*")


@functools.lru_cache(maxsize=4)
def load_bytes(path: str) -> PlainPieces:
    return PlainPieces(path)


@functools.lru_cache(maxsize=4)
def load_spaces(path: str) -> SpacePieces:
    return SpacePieces(path)


def gallop(short: np.ndarray, long: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """For each element of ``short`` the first place in ``long`` that isn't less; both ascend, the last of ``long`` is no less than any.

    All elements go at once: every ``stride``-th is found first (by the same rule), and the others start there.
    """
    start = np.repeat(gallop(short[::stride], long, stride), stride)[: len(short)] if len(short) > stride else np.zeros(len(short), np.int64)
    low, high, last = start.copy(), start, len(long) - 1
    on, step = np.flatnonzero(long[start] < short) if len(short) else np.zeros(0, np.int64), 1
    gone = on
    while len(on):
        probe = np.minimum(low[on] + step, last)
        found = long[probe] >= short[on]
        high[on[found]] = probe[found]
        low[on[~found]] = probe[~found]
        on = on[~found]
        step *= 2
    on = gone[high[gone] - low[gone] > 1]
    while len(on):
        middle = (low[on] + high[on]) >> 1
        less = long[middle] < short[on]
        low[on[less]], high[on[~less]] = middle[less], middle[~less]
        on = on[high[on] - low[on] > 1]
    return high


def intersect(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, first, last): whether each end of ``short`` is one of ``long``, and the tokens of ``long`` that its token overlaps."""
    last = gallop(short, long)
    common = long[last] == short
    first = np.concatenate([[0], last[:-1] + common[:-1]]).astype(np.int64)[: len(short)]
    return common, first, last


@functools.lru_cache(maxsize=8)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids as rows of bytes, padded with zeros, with room for a separator, and the lengths with it."""
    width = len(str(size - 1)) + 1
    rows = np.frombuffer("".join(str(k).ljust(width, "\0") for k in range(size)).encode(), np.uint8).reshape(size, width)
    return rows, np.array([len(str(k)) + 1 for k in range(size)], np.int64)


def _written(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, last_b: np.ndarray, sizes: tuple[int, int]) -> list[bytes]:
    """The groups of each text, as a1,a2|b1;a3|b2: ends tell each list's last tokens of groups, last_b the last token of each text."""
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    before_b = np.concatenate([[0], np.flatnonzero(end_b) + 1])
    through_a = np.flatnonzero(end_a) + 1
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + through_a[group_b]
    width = len(str(max(sizes) - 1)) + 1
    (rows, lengths), out = _digits(max(sizes)), np.empty((len(a) + len(b), width), np.uint8)
    out[at_a], out[at_b] = rows[a], rows[b]
    out[at_a, width - 1] = np.where(end_a, ord("|"), ord(","))
    out[at_b, width - 1] = np.where(end_b, ord(";"), ord(","))
    out[at_b[last_b], width - 1] = 0
    size = np.empty(len(out), np.int64)
    size[at_a], size[at_b] = lengths[a], lengths[b]
    stops = np.cumsum(size)[at_b[last_b]] - np.arange(1, len(last_b) + 1)
    flat = out.ravel()
    raw = flat[flat != 0].tobytes()
    return [raw[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def align(texts: list[str], one: PlainPieces, two: SpacePieces) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of _MADE for each text, and pairs: distinct ones (a << 32 | b), their numbers and times in each text, and how many a text has."""
    n = len(texts)
    ids_a, ids_b = one.encode_all([" " + t if t else "" for t in texts]), two.encode_all(texts)
    a, b = [np.frombuffer(x, "<u4") for x in ids_a], [np.frombuffer(x, "<u4") for x in ids_b]
    made = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups_sha256": [""] * n}
    first, second = [], []
    for k, text in enumerate(texts):
        if text:
            raw = (" " + text).encode()
            if b"".join(map(one.bytes.__getitem__, a[k].tolist())) == raw == b"".join(map(two.bytes.__getitem__, b[k].tolist())):
                (first if len(a[k]) <= len(b[k]) else second).append(k)
    keys, owners = [], []
    for docs, a_drives in ((first, True), (second, False)):
        if not docs:
            continue
        na, nb = np.array([len(a[k]) for k in docs]), np.array([len(b[k]) for k in docs])
        xa, xb = np.concatenate([a[k] for k in docs]).astype(np.int64), np.concatenate([b[k] for k in docs]).astype(np.int64)
        ends_a, ends_b = np.cumsum(one.lengths[xa]), np.cumsum(two.lengths[xb])
        common, begin, last = intersect(*((ends_a, ends_b) if a_drives else (ends_b, ends_a)))
        other = np.zeros(len(xb) if a_drives else len(xa), bool)
        other[last[common]] = True
        end_a, end_b = (common, other) if a_drives else (other, common)
        times = last - begin + 1
        driver = np.repeat(np.arange(len(times)), times)
        met = np.arange(len(driver)) - np.repeat(np.cumsum(times) - times, times) + begin[driver]
        keys.append((xa[driver] << 32 | xb[met]) if a_drives else (xa[met] << 32 | xb[driver]))
        n_drive = na if a_drives else nb
        starts = np.cumsum(n_drive) - n_drive
        links, groups = np.add.reduceat(times, starts), np.add.reduceat(common.astype(np.int64), starts)
        owners.append(np.repeat(np.array(docs), links))
        written = _written(xa, xb, end_a, end_b, np.cumsum(nb) - 1, (len(one.bytes), len(two.bytes)))
        for k, *row in zip(docs, na.tolist(), nb.tolist(), groups.tolist(), links.tolist(), (hashlib.sha256(w).hexdigest() for w in written), strict=True):
            for name, value in zip(made, row, strict=True):
                made[name][k] = value
    if not keys:
        none = np.zeros(0, np.int64)
        return made, none, none, none, np.zeros(n, np.int64)
    numbers, distinct = pd.factorize(np.concatenate(keys))
    held, times = np.unique(np.concatenate(owners) * len(distinct) + numbers, return_counts=True)
    return made, distinct, held % len(distinct), times, np.bincount(held // len(distinct), minlength=n)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs, which is said first."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep: list[Column] | None = None, text: Column | None = None, run: int = RUN) -> DataFrame:
    """Columns ``keep`` (doc_id by default) and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    ``path_a`` is a byte-level file of tokenizers and encodes a space and the text; ``path_b`` a SentencePiece
    model that puts that space itself. Texts that are null, empty or not given back by both byte for byte
    (such as those that hold the space mark U+2581) have no tokens: zeros and ''. Rows with equal or null ids
    are rows of their own. An empty table gives no rows. A text is one task's work, however long.
    """
    keep = [F.col("doc_id")] if keep is None else keep
    source = docs.select(F.struct(*keep).alias("_keep"), (F.col("text") if text is None else text).alias("_text"))
    kept = source.schema["_keep"].dataType.simpleString()
    schema = f"block string, docs array<struct<keep:{kept},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,n_pairs:bigint>>, pairs array<bigint>, totals array<bigint>, numbers binary, times binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = load_bytes(path_a), load_spaces(path_b)
        for batch in batches:
            for at, texts in text_batches(batch.column(1).to_pylist(), run):
                made, distinct, numbers, times, sizes = align(texts, one, two)
                fields = [batch.column(0).slice(at, len(texts)), *(pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in made.items()), pa.array(sizes, pa.int64())]
                rows = pa.StructArray.from_arrays(fields, names=["keep", *made, "n_pairs"])
                totals = np.bincount(numbers, weights=times, minlength=len(distinct)).astype(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, pa.int64())) for v in (rows, distinct, totals)]
                packed = [pa.array([_packed(v)], pa.binary()) for v in (numbers, times)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *packed], names=["block", "docs", "pairs", "totals", "numbers", "times"])

    blocks = stash(source.mapInArrow(encode, schema), "aligned-blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("number", "_p")).select("block", "number", F.col("_p.pairs").alias("pair"), F.col("_p.totals").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    ranked = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    told = pairs.join(ranked, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "count", "best"))).alias("told"))
    told = stash(told.select("block", F.col("told.count").alias("counts"), F.col("told.best").alias("best")), "pair-counts")
    ready = blocks.drop("pairs", "totals").join(told, "block", "left")
    fields = [*source.schema["_keep"].dataType.fields, *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c.slice(k, 1) for c in batch.columns), strict=True))
                docs = row["docs"].flatten()
                each = dict(zip([f.name for f in docs.type], docs.flatten(), strict=True))
                numbers, times = (_unpacked(row[x][0].as_py()) for x in ("numbers", "times"))
                counts, best = (np.asarray(row[x].flatten().to_numpy(zero_copy_only=False)) for x in ("counts", "best"))
                sizes = each["n_pairs"].to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
                if len(numbers):
                    np.add.at(sums[0], owner, times * best[numbers].astype(np.int64))
                    np.add.at(sums[1], owner, times * counts[numbers].astype(np.int64))
                columns = [*each["keep"].flatten(), *(each[x] for x in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), each["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    out = stash(ready.select("docs", "numbers", "times", "counts", "best").mapInArrow(spread, StructType(fields)), "aligned")
    discard(blocks, told)
    return out
