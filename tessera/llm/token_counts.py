"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

A task groups its documents into blocks and turns each block into an inverted list: for each
distinct pre-token, the documents that hold it and how often. Pre-tokens that are pieces
themselves count 1 and are summed on the spot; that table is the tokenizer's vocabulary, whose
size is fixed. The others meet in one exchange, sorted by pre-token, where each distinct one is
split into pieces once and its count joined, in passing, to the lists of all blocks. A pre-token that
fills much of a block is dealt by block as well, so it is split once in each of some tasks. Sums
return by block. No ids are made for any document.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pieces

#: Characters in a block, which bounds what a task keeps in memory at once.
BLOCK = 24_000_000
#: A list of more documents is dealt by its block too, to one of SALTS tasks, each of which splits the pre-token anew.
LONG, SALTS = 1024, 64
#: Places that a task adds up at once; sums leave in portions.
HELD = 8_000_000


def _block(ids, texts, path: str, name: str, long: int) -> pd.DataFrame:
    """A block's inverted lists, and one row with its documents and their counts so far."""
    p = pieces.load(path)
    lists: dict[str, list[int]] = {}
    base, size = [], []
    known = p.words
    for k, text in enumerate(texts):
        size.append(len(text.encode("utf-8", "surrogatepass")))
        total = 0
        for token, n in Counter(p.pre_tokens(text)).items():
            if token in p.special or token.encode("utf-8", "surrogatepass") in known:
                total += n
            elif (found := lists.get(token)) is None:
                lists[token] = [k, n]
            else:
                found += (k, n)
        base.append(total)
    meta = np.stack([np.array([x or 0 for x in ids], "<i8"), np.array([x is not None for x in ids], "<i8"), np.array(size, "<i8"), np.array(base, "<i8")])
    tokens = ["t" + t for t in lists]
    payload = [np.array(v, "<u4").astype("<u2" if len(texts) < 65536 and max(v) < 65536 else "<u4").tobytes() for v in lists.values()]
    wide = [len(b) != len(v) * 2 for b, v in zip(payload, lists.values(), strict=True)]
    own = crc32(name.encode()) % SALTS + 1
    salt = [own if len(v) > 2 * long else 0 for v in lists.values()]
    return pd.DataFrame({"token": [*tokens, "m" + name], "salt": pd.array([*salt, 0], "int32"), "block": name, "wide": [*wide, False], "payload": [*payload, meta.tobytes()]})


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """One row for each row of ``docs``: id, UTF-8 bytes, tokens, and whether these exceed ``limit``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library. Null and empty texts have 0
    tokens; rows with null or repeated ids are counted like any other row; an empty table gives an
    empty result; other columns are not read. Special strings inside a text count as their one id.
    """

    def arrow(frame):
        return pa.RecordBatch.from_pandas(frame, pa.schema([("token", pa.string()), ("salt", pa.int32()), ("block", pa.string()), ("wide", pa.bool_()), ("payload", pa.binary())]), preserve_index=False)

    def blocks(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t or ""
                if texts and held + len(t) > block:
                    yield arrow(_block(ids, texts, tokenizer, f"{part}-{seq}", long))
                    ids, texts, held, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield arrow(_block(ids, texts, tokenizer, f"{part}-{seq}", long))

    def added(places):
        """The sums gathered so far, block by block."""
        for block, found in places.items():
            at, add = (np.concatenate(x) for x in zip(*found, strict=True))
            total = np.bincount(at, weights=add).astype("i8")
            where = np.flatnonzero(total)
            yield pd.DataFrame({"block": [block], "meta": [False], "payload": [np.stack([where, total[where]]).astype("<i8").tobytes()]})

    def sums(frames):
        """What a task's pre-tokens add to each document of a block: (place, sum) pairs.

        Lists come in order of their pre-token, so each distinct one is split into pieces once.
        """
        p = pieces.load(tokenizer)
        places: dict[str, list] = {}
        held = 0
        last: dict[str, int] = {}
        for frame in frames:
            new = [t for t in frame["token"].unique().tolist() if t not in last]
            last |= dict(zip(new, p.counts([t[1:] if t[0] == "t" else "" for t in new]), strict=True))
            for token, block, wide, payload in zip(frame["token"], frame["block"], frame["wide"], frame["payload"], strict=True):
                n = last[token]
                if token[0] == "m":
                    yield pd.DataFrame({"block": [block], "meta": [True], "payload": [payload]})
                    continue
                pair = np.frombuffer(payload, "<u4" if wide else "<u2").reshape(-1, 2)
                places.setdefault(block, []).append((pair[:, 0].astype("i8"), pair[:, 1].astype("i8") * n))
                held += len(pair)
                if held > HELD:
                    yield from added(places)
                    places, held = {}, 0
            last = {k: last[k] for k in [frame["token"].iloc[-1]]} if len(frame) else last
        yield from added(places)

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(group.loc[group["meta"], "payload"].iloc[0], "<i8").reshape(4, -1)
        total = meta[3].copy()
        for payload in group.loc[~group["meta"], "payload"]:
            at, add = np.frombuffer(payload, "<i8").reshape(2, -1)
            total[at] += add
        ids = pd.Series(meta[0], dtype="Int64").where(pd.Series(meta[1] == 1))
        return pd.DataFrame({"id": ids, "n_bytes": meta[2], "n_tokens": total})

    lists = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(blocks, "token string, salt int, block string, wide boolean, payload binary")
    partial = lists.repartition("token", "salt").sortWithinPartitions("token").mapInPandas(sums, "block string, meta boolean, payload binary")
    out = partial.groupBy("block").applyInPandas(rows, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
