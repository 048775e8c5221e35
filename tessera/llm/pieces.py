"""Encoding with a tokenizer file: exact pre-tokens, memoised pieces, decoding.

The file's own library encodes every distinct pre-token; this module only avoids asking it
for the same pre-token twice within a task.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: The pre-token pattern of byte-level BPE, spelled out for texts below U+0250. It is a fixed
#: value of the tokenizer file; other texts go to the library's own pre-tokenizer.
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+"
    r"| ?[^\sA-Za-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"
)
#: Outside the range of LATIN, or white space on which libraries differ.
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")
#: Cached pre-tokens in a Python worker.
CACHE = 400_000


def _byte_table() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """A tokenizer with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        #: Only this set-up is known to encode each pre-token on its own, whatever stands around it.
        self.split_ok = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        table = _byte_table()
        size = max(self.tok.get_vocab_size(), *self.special.values(), 0) + 1
        self.bytes = [b""] * size
        for piece, k in self.tok.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        for piece, k in self.special.items():
            self.bytes[k] = piece.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.words = {b: k for k, b in enumerate(self.bytes)}
        self.ids: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings are pre-tokens of their own."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif _OTHER.search(part):
                at = [span for _, span in self.tok.pre_tokenizer.pre_tokenize_str(part)]
                out.extend(part[a:b] for a, b in at)
            else:
                out.extend(LATIN.findall(part))
        return out

    def learn(self, tokens) -> None:
        """Encode pre-tokens that aren't in the memory yet, all in one call of the library."""
        new = [t for t in tokens if t not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            new = list(dict.fromkeys(tokens))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for t, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False), strict=True):
                self.ids[t] = np.array(e.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.split_ok:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        tokens = self.pre_tokens(text)
        try:
            return b"".join(map(self.ids.__getitem__, tokens))
        except KeyError:
            self.learn(dict.fromkeys(tokens))
            return b"".join(map(self.ids.__getitem__, tokens))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As encode(), but asks the library once for what all the texts need."""
        if self.split_ok:
            split = [self.pre_tokens(t) for t in texts]
            need: set[str] = set()
            for tokens in split:
                need.update(tokens)
            self.learn(need)
            return [b"".join(map(self.ids.__getitem__, tokens)) for tokens in split]
        return [self.encode(t) for t in texts]

    def counts(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, without keeping any ids."""
        out: list[int] = []
        for k in range(0, len(tokens), 20_000):
            out.extend(len(e) for e in self.tok.encode_batch(tokens[k : k + 20_000], add_special_tokens=False))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; bytes that are no UTF-8 decode as U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """One tokenizer for each Python worker."""
    return Pieces(path)
