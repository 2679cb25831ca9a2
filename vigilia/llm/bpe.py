"""Byte-level BPE in tasks: ids of whole texts, equal to those of the ``tokenizers`` file named by a path.

Pre-tokens never reach over a single space that stands between two characters that are no white space, so a text falls
into units there and the ids of a unit are those of the unit alone. A process remembers the units it has met, up to
``CACHE_UNITS``; any text with other white space around a space is encoded in one go instead.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import regex
import tiktoken

#: Fixed value: the pre-token pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_UNITS, LONGEST_CACHED = 250_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Whole(Exception):
    """White space around a space: the text has to be encoded in one go."""


class Units(dict):
    """Ids of ``" " + unit``, computed when first asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Whole
        ids = packed(self.encode(" " + unit))
        if len(self) < CACHE_UNITS and len(unit) <= LONGEST_CACHED:
            self[unit] = ids
        return ids


class ByteBpe:
    """Ids as little-endian unsigned 32-bit integers. Special strings in a text become their ids, as the file says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, model = byte_symbols(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units = Units(self.core.encode_ordinary)
        self.pieces = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """Ordinary and special stretches in turn, beginning with an ordinary one (maybe empty)."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return self.cut.split(text)

    def ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or first and first[-1].isspace():
            return packed(self.core.encode_ordinary(text))
        last = rest.pop()
        try:
            if not last or last[0].isspace():
                raise _Whole
            middle = b"".join(map(self.units.__getitem__, rest))
        except _Whole:
            return packed(self.core.encode_ordinary(text))
        return packed(self.core.encode_ordinary(first)) + middle + packed(self.core.encode_ordinary(" " + last))

    def ids(self, text: str) -> bytes:
        parts = self.segments(text)
        if len(parts) == 1:
            return self.ordinary(text)
        return b"".join(packed([self.special[p]]) if i % 2 else self.ordinary(p) for i, p in enumerate(parts))

    def piece_counts(self, text: str) -> tuple[list[int], list[int]]:
        """Where each pre-token or special string begins, and the tokens before each; at the end the length and the total."""
        starts, before, at, total = [], [], 0, 0
        for i, part in enumerate(self.segments(text)):
            if i % 2:
                starts.append(at)
                before.append(total)
                total += 1
            else:
                for m in self.pieces.finditer(part):
                    starts.append(at + m.start())
                    before.append(total)
                    total += len(self.core.encode_ordinary(m[0]))
            at += len(part)
        return [*starts, at], [*before, total]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One per process and file."""
    return ByteBpe(path)
