"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, hence equal passages are cut alike
wherever they stand. A first scan makes chunk keys only. A key that occurs more than once is
shared: its chunk is encoded in one document, and all documents that hold it take these ids over.
Chunk joins are repaired by encoding the text around a join again, over ever wider windows, until
the ids agree with those of both chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing, pieces
from tessera.llm.common import text_batches

#: The rolling hash covers 2**STEPS bytes; chunks average 2**BITS bytes more than LEAST.
STEPS, BITS, LEAST = 5, 10, 256
_VALUE = hashing.mix(np.arange(256, dtype=np.uint64) + np.uint64(77_777))
_BASE = 0xD1342543DE82EF95
#: White space after something that no library takes for white space: every pre-token ends there.
_EDGE = re.compile(r"(?<=[^\s\x00-\x1f\x7f-\xa0])[ \n]")


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, always between characters; the last is len(raw)."""
    n = len(raw)
    if n <= 2 * LEAST:
        return [n] if n else []
    roll, width = _VALUE[np.frombuffer(raw, np.uint8)], 1
    for _ in range(STEPS):
        roll = roll[:-width] * np.uint64(pow(_BASE, width, 2**64)) + roll[width:]
        width *= 2
    found = np.flatnonzero(hashing.mix(roll) >> np.uint64(64 - BITS) == 0) + width
    out, last = [], 0
    for at in found.tolist():
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= LEAST and n - at >= LEAST:
            out.append(at)
            last = at
    return [*out, n]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_key(chunk: bytes) -> int:
    """A 64-bit hash. Equal keys are only a hint: ids that are taken over must decode to the chunk."""
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def _edges(text: str, backwards: bool):
    """Edges of a text, from its end or from its start, looking at ever more of it."""
    size, seen = 64, -1
    while True:
        part = text[-size:] if backwards else text[:size]
        base = len(text) - len(part) if backwards else 0
        found = [base + m.start() for m in _EDGE.finditer(part)]
        for at in (reversed(found) if backwards else found):
            if seen < 0 or (at < seen if backwards else at > seen):
                yield at
                seen = at
        if size >= len(text):
            return
        size *= 8


def _split(p: pieces.Pieces, ids: bytes, at: int) -> int:
    """How many bytes of ``ids`` cover the first ``at`` bytes of text; -1 if a token straddles."""
    reach = np.cumsum(p.lengths[np.frombuffer(ids, "<u4")])
    k = int(np.searchsorted(reach, at))
    return (k + 1) * 4 if k < len(reach) and reach[k] == at else -1


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def join_chunks(p: pieces.Pieces, parts: list[str], encoded: list[bytes]) -> bytes:
    """The ids of the concatenated chunks, from the ids of each.

    Between two chunks the text from an edge before the join to an edge after it is encoded anew.
    The result is taken once both chunks' ids break at those edges and their outer parts, encoded
    alone, give what the chunks have there; until then the window grows by an edge on each side, and
    at last to the whole of both.
    """
    done: list[bytes] = []
    text, ids = parts[0], encoded[0]
    for part, code in zip(parts[1:], encoded[1:], strict=True):
        for a, b in zip(_edges(text, True), _edges(part, False), strict=False):
            i, j = _split(p, ids, _size(text[:a])), _split(p, code, _size(part[:b]))
            if i >= 0 and j >= 0 and p.encode(text[a:]) == ids[i:] and p.encode(part[:b]) == code[:j]:
                done += [ids[:i], p.encode(text[a:] + part[:b])]
                text, ids = part[b:], code[j:]
                break
        else:
            text += part
            ids = p.encode(text)
    return b"".join([*done, ids])


def encode_texts(p: pieces.Pieces, texts: list[str], known: list[dict[int, bytes]]) -> tuple[list[bytes], list[int]]:
    """The ids of each text, and how many of its chunks took over known ids."""
    split = [chunks(t.encode("utf-8", "surrogatepass")) for t in texts]
    codes: list[list[bytes | None]] = []
    fresh: list[str] = []
    for parts, have in zip(split, known, strict=True):
        row = []
        for part in parts:
            ids = have.get(chunk_key(part)) if have else None
            if ids is not None and b"".join(map(p.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) != part:
                ids = None
            if ids is None:
                fresh.append(part.decode("utf-8", "surrogatepass"))
            row.append(ids)
        codes.append(row)
    new = iter(p.encode_all(fresh))
    out, reused = [], []
    for parts, row in zip(split, codes, strict=True):
        reused.append(sum(x is not None for x in row))
        full = [next(new) if x is None else x for x in row]
        out.append(full[0] if len(full) == 1 else join_chunks(p, [x.decode("utf-8", "surrogatepass") for x in parts], full) if full else b"")
    return out, reused


def _packed(p: pieces.Pieces) -> str:
    """The type of ids on their way between documents."""
    return "<u2" if len(p.bytes) <= 1 << 16 else "<u4"


def both_forms(ids: bytes, decoded: bytes) -> tuple:
    """What encode_documents returns of a document by default."""
    return np.frombuffer(ids, "<u4").tolist(), decoded.decode()


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    emit: Callable[[bytes, bytes], tuple] = both_forms,
    schema: str = "ids array<long>, decoded string",
) -> DataFrame:
    """One row for each row of ``docs``: its id, what ``emit`` makes of it, its chunks and the reused ones.

    ``emit`` gets a document's ids (little-endian uint32) and the decoded text (UTF-8), both as the
    tokenizers library gives them for the whole text; ``schema`` names and types its results. With a
    digest as ``emit``, ids never leave the task. Null texts are empty and give no ids; null and
    repeated ids keep their rows (null ids share no chunks); an empty table gives an empty result;
    other columns are not read. A text of any length is one row of many chunks.
    """
    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = both.where(F.col("id").isNotNull())
    columns = f"id long, {schema}, n_chunks int, n_reused int"
    names = [x.strip().split()[0] for x in schema.split(",")]

    def scan(frames):
        for frame in frames:
            ids = frame["id"].to_numpy()
            for start, texts in text_batches(frame["text"]):
                keys = [[chunk_key(c) for c in chunks(t.encode("utf-8", "surrogatepass"))] for t in texts]
                sizes = [len(x) for x in keys]
                yield pd.DataFrame({"id": np.repeat(ids[start : start + len(texts)], sizes), "chunk": np.array([k for x in keys for k in x], np.int64)})

    def give(frames):
        p = pieces.load(tokenizer)
        for frame in frames:
            out: dict[int, str] = {}
            for text, wanted in zip(frame["text"], frame["chunks"], strict=True):
                wanted = set(wanted.tolist())
                for part in chunks((text or "").encode("utf-8", "surrogatepass")):
                    if (key := chunk_key(part)) in wanted and key not in out:
                        out[key] = part.decode("utf-8", "surrogatepass")
            packed = [np.frombuffer(x, "<u4").astype(_packed(p)).tobytes() for x in p.encode_all(list(out.values()))]
            yield pd.DataFrame({"chunk": np.array(list(out), np.int64), "ids": packed})

    def finish(frames):
        p = pieces.load(tokenizer)
        for frame in frames:
            for start, texts in text_batches(frame["text"]):
                part = frame.iloc[start : start + len(texts)]
                known = [{x["chunk"]: np.frombuffer(x["ids"], _packed(p)).astype("<u4").tobytes() for x in found} if found is not None else {} for found in part["known"]]
                ids, reused = encode_texts(p, texts, known)
                made = [emit(i, p.decode(i)) for i in ids]
                out = {"id": part["id"].to_numpy()} | {n: [m[k] for m in made] for k, n in enumerate(names)}
                yield pd.DataFrame(out | {"n_chunks": [len(cuts(t.encode("utf-8", "surrogatepass"))) for t in texts], "n_reused": reused})

    def finish_unnamed(frames):
        return (x.assign(id=pd.array([None] * len(x), "Int64")) for x in finish(f.assign(known=None) for f in frames))

    held = named.mapInPandas(scan, "id long, chunk long")
    shared = held.groupBy("chunk").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")).where("copies > 1")
    dealt = named.repartition("id")  # one exchange of the texts, which both joins below use
    givers = shared.groupBy(F.col("first").alias("id")).agg(F.collect_set("chunk").alias("chunks"))
    given = dealt.join(givers, "id").mapInPandas(give, "chunk long, ids binary").groupBy("chunk").agg(F.first("ids").alias("ids"))
    known = held.distinct().join(given, "chunk").groupBy("id").agg(F.collect_list(F.struct("chunk", "ids")).alias("known"))
    out = dealt.join(known, "id", "left").select("id", "text", "known").mapInPandas(finish, columns)
    rest = both.where(F.col("id").isNull()).mapInPandas(finish_unnamed, columns)
    return out.unionByName(rest).withColumnRenamed("id", id_col)
