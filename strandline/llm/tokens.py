"""Token ids of whole texts by the tokenizers library, one library call per distinct word.

The tokenizer splits at white space before anything else and never joins across it, so the
ids of a text are the ids of its white-space separated chunks in order. Texts repeat their
chunks; each worker keeps the ids of the chunks it has met, in a table of bounded size. New
chunks of plain letters and signs are cut into the tokenizer's own units, which repeat even
more, and only new units go to the library's model; any other chunk goes through the whole
tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandline.llm.words import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
KNOWN = 300_000
#: Printable ASCII but ' and <, which start contractions and special tokens, and Latin-1 letters.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
UNIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_signs() -> list[str]:
    """The sign that byte-level tokenizers write for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


# fixed value: the cutting rule that UNIT restates for plain chunks
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = _byte_signs()


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Chunk to its number; a new chunk gets the next one and waits to be encoded."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class Encoder:
    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.plain = self._is_plain(path)
        self.forget()

    @staticmethod
    def _is_plain(path: str) -> bool:
        """Whether the file's own rules are those that PLAIN and UNIT restate."""
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        normal = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return normal == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"].get("Regex") == RULE

    def _unit(self, unit: str) -> bytes:
        """Ids as packed integers: a tenth of the memory of a list."""
        ids = self.units.get(unit)
        if ids is None:
            written = unit if unit.isascii() else "".join(SIGNS[b] for b in unit.encode())
            ids = self.units[unit] = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return ids

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = []
        for chunk in (c.decode("utf-8", "replace") for c in chunks):
            if self.plain and PLAIN.fullmatch(chunk):
                units = UNIT.findall(chunk.lower())
                out.append(self._unit(units[0]) if len(units) == 1 else b"".join(map(self._unit, units)))
            else:
                out.append(None)
        rest = [k for k, x in enumerate(out) if x is None]
        found = self.tokenizer.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)
        for k, e in zip(rest, found, strict=True):
            out[k] = array("I", e.ids).tobytes()
        return out

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.units: dict[str, bytes] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        found = self._ids_of(fresh)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total, n = int(size.sum()), len(self.numbers)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(found), np.uint32)
        self.size[n - len(fresh) : n] = size
        self.first[n - len(fresh) : n] = self.used + np.cumsum(size) - size
        self.used += total

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of texts end to end, their offsets); a null text is empty."""
        for row, data, offsets in slices(texts):
            if len(self.numbers) + len(self.units) > 2 * self.known:
                self.forget()
            raw = data.tobytes()
            cuts = offsets.tolist()
            chunks: list[bytes] = []
            counts = [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                chunks += raw[a:b].split()
                counts.append(len(chunks))
            which = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
            self._learn()
            size = self.size[which]
            ends = np.zeros(len(which) + 1, np.int64)
            np.cumsum(size, out=ends[1:])
            at = np.repeat(self.first[which] - ends[:-1], size)
            at += np.arange(len(at))
            yield row, self.flat[at], ends[counts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file: reused by all tasks that run in the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release(path: str) -> None:
    """Forget the chunks of a finished task: an idle worker keeps no memory that others need."""
    if path in _ENCODERS:
        _ENCODERS[path].forget()


def documents_ids(texts: pa.Array, path: str, end: int) -> Iterator[np.ndarray]:
    """The ids of each text, then the end id."""
    for _, ids, offsets in encoder(path).encode(texts):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.append(ids[a:b], np.uint32(end))
