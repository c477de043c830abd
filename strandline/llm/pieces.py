"""Sampled SentencePiece segmentations: forward filtering, backward sampling; lossless decoding.

The pieces that fit a text form a lattice; a segmentation is a path, its probability is
proportional to the product of its pieces' weights. Forward filtering adds up the weights of
all paths to each position; backward sampling then draws the last piece, the one before, and
so on, each with its exact conditional probability.

No piece goes on after a blank that follows another sign, so the lattice falls apart into
units, a word with the blanks before it. Filtering is done once for each distinct unit;
sampling is done for all units of a slice of texts together. Draws are hashes of the row's
key, the unit's place and the step: the same row gives the same ids on any cluster.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.store import texts as text_columns
from strandline.llm.words import BASE, INVERSE, mix, slices

MODEL = "piece_bpe_32k.model"
ALPHA, SEED = 1.0, 8
#: Distinct units whose lattices a worker keeps.
KNOWN = 200_000
BLANK = "▁"
UNIT = re.compile(rb" +[^ ]*")
LITERAL = 0x110000


def public_model(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a)), a.dtype)))


class Vocabulary:
    """Pieces of a model file with their log weights, and the bytes each stands for.

    The weight of a piece is its probability in a unigram model. A BPE model has only the
    order of its merges: there the weight is 1 / (2 + rank), as frequencies fall with rank.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        score = np.array([sp.get_score(i) for i in range(n)])
        bpe = score.min() < -1000
        self.weight = alpha * (-np.log(2 + np.clip(-score, 0, n)) if bpe else score)
        self.least = float(self.weight.min())
        self.byte = {}
        self.bytes: list[bytes] = []
        self.names: dict[str, int] = {}
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
                self.bytes.append(bytes([int(name[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.names[name] = i
                self.bytes.append(name.replace(BLANK, " ").encode())
        # every beginning of a piece by hash, with the piece's id if it is one
        names = list(self.names)
        sizes = np.array([len(x) for x in names], np.int64)
        begin, number = np.cumsum(sizes) - sizes, np.array([self.names[x] for x in names], np.int64)
        total, down = _prefix_sums(_code_points("".join(names)))
        hashed, ids = [], []
        for k in range(1, int(sizes.max(initial=0)) + 1):
            at = begin[sizes >= k]
            hashed.append(mix((total[at + k] - total[at]) * down[at] + np.uint64(k)))
            ids.append(np.where(sizes[sizes >= k] == k, number[sizes >= k], -1))
        hashed, ids = np.concatenate(hashed), np.concatenate(ids)
        order = np.lexsort((-ids, hashed))
        self.hash, first = np.unique(hashed[order], return_index=True)
        self.id_of = ids[order][first]
        self.may = np.zeros(1 << 22, bool)
        self.may[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.longest = max(map(len, self.names), default=0)

    def decode(self, ids) -> str:
        """The text of a segmentation: every byte of it, blanks and unusual signs included."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _prefix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(len(points) + 1, b, np.uint64) for b in (BASE, INVERSE))
    up[0] = down[0] = 1
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * np.cumprod(up, dtype=np.uint64)[:-1], out=total[1:])
    return total, np.cumprod(down, dtype=np.uint64)


class Sampler:
    """Lattices of the units met so far, with the conditional probabilities for sampling."""

    def __init__(self, vocabulary: Vocabulary, known: int = KNOWN):
        self.v, self.known = vocabulary, known
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.end = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.total = np.zeros(1024)
        self.first = np.zeros(1 << 14, np.int64)
        self.nodes = self.edges = 0
        self.chance, self.before, self.piece = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        # pieces from the size of the vocabulary on stand for the bytes of a sign that has no piece
        self.spelled: dict[int, int] = {}
        self.spelling: list[list[int]] = []

    def _spell(self, point: int) -> int:
        code = self.spelled.get(point)
        if code is None:
            raw = chr(point).encode("utf-8", "surrogatepass")
            ids = [self.v.byte.get(b, self.v.unknown) for b in raw]
            if len(ids) == 1:
                code = ids[0]
            else:
                code = len(self.v.bytes) + len(self.spelling)
                self.spelling.append(ids)
            self.spelled[point] = code
        return code

    def learn(self, fresh: list[bytes]) -> None:
        """Filter the lattices of new units forward. A literal blank sign is spelled by its bytes."""
        if not fresh:
            return
        units = [" " + u.decode("utf-8", "replace") for u in fresh]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = _code_points("".join(units))
        # a blank becomes the pieces' sign for it; that sign itself a number that no piece has
        points = np.where(points == 0x20, 0x2581, np.where(points == 0x2581, LITERAL, points)).astype(np.uint64)
        begin = np.cumsum(sizes) - sizes
        limit = np.repeat(begin + sizes, sizes)
        total, down = _prefix_sums(points)
        at = np.arange(len(points))
        starts, ends, ids = [], [], []
        for size in range(1, self.v.longest + 1):
            at = at[at + size <= limit[at]]
            h = mix((total[at + size] - total[at]) * down[at] + np.uint64(size))
            may = self.v.may[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            at, h = at[may], h[may]
            if not len(at):
                break
            k = np.minimum(np.searchsorted(self.v.hash, h), len(self.v.hash) - 1)
            true = self.v.hash[k] == h
            at, k = at[true], k[true]
            i = self.v.id_of[k]
            starts.append(at[i >= 0])
            ends.append(at[i >= 0] + size)
            ids.append(i[i >= 0])
        single = np.zeros(len(points), bool)
        if starts:
            single[starts[0]] = True
        bare = np.flatnonzero(~single)
        starts.append(bare)
        ends.append(bare + 1)
        codes = [self._spell(0x2581 if p == LITERAL else p) for p in points[bare].tolist()]
        ids.append(np.array(codes, np.int64))
        s, e, piece = (np.concatenate(x) for x in (starts, ends, ids))
        spelled = np.array([1, *map(len, self.spelling)][1:], np.float64)
        weight = np.where(piece < len(self.v.weight), self.v.weight[np.minimum(piece, len(self.v.weight) - 1)], 0.0)
        if len(spelled):
            long = piece >= len(self.v.weight)
            weight[long] = self.v.least * spelled[piece[long] - len(self.v.weight)]
        weight[np.isin(piece, list(self.v.byte.values()))] = self.v.least
        # nodes of unit k: begin[k] + k ... begin[k] + k + sizes[k]
        unit = np.repeat(np.arange(len(units)), sizes)
        s, e, place = s + unit[s], e + unit[s], e - begin[unit[s]]
        order = np.argsort(place * (int(e.max()) + 1) + e, kind="stable")
        s, e, piece, weight, place = (x[order] for x in (s, e, piece, weight, place))
        count = int(sizes.sum()) + len(units)
        score = np.zeros(count)
        chance = np.empty(len(s))
        new = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
        node = e[new]
        cuts = np.searchsorted(place[new], np.arange(1, int(place[-1]) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = new[a], (new[b] if b < len(new) else len(s))
            group = new[a:b] - lo
            ways = np.diff(np.append(group, hi - lo))
            x = score[s[lo:hi]] + weight[lo:hi]
            most = np.maximum.reduceat(x, group)
            x = np.exp(x - np.repeat(most, ways))
            sums = np.add.reduceat(x, group)
            score[node[a:b]] = most + np.log(sums)
            run = np.cumsum(x / np.repeat(sums, ways))
            run -= np.repeat(run[group] - x[group] / sums, ways)
            run[np.append(group[1:], hi - lo) - 1] = 2.0  # rounding never steps over the last
            chance[lo:hi] = run
        n, m = len(self.number), len(fresh)
        self.start, self.end, self.total = (_grown(x, n + m) for x in (self.start, self.end, self.total))
        base = begin + np.arange(m) + self.nodes
        self.start[n : n + m], self.end[n : n + m] = base, base + sizes
        self.total[n : n + m] = score[base + sizes - self.nodes]
        self.first = _grown(self.first, self.nodes + count)
        self.first[self.nodes + node] = self.edges + new
        self.chance, self.before, self.piece = (_grown(x, self.edges + len(s)) for x in (self.chance, self.before, self.piece))
        for mine, x in ((self.chance, chance), (self.before, s + self.nodes), (self.piece, piece)):
            mine[self.edges : self.edges + len(s)] = x
        self.nodes, self.edges = self.nodes + count, self.edges + len(s)
        for k, u in enumerate(fresh):
            self.number[u] = n + k

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units in order, how many each unit has): one path for each seed."""
        node, stop = self.end[unit], self.start[unit]
        live, taken, who, step = np.arange(len(unit)), [], [], 0
        while len(live):
            u = (mix(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) * 2.0**-53
            e = self.first[node[live]]
            late = np.flatnonzero(self.chance[e] <= u)
            while len(late):
                e[late] += 1
                late = late[self.chance[e[late]] <= u[late]]
            taken.append(self.piece[e])
            who.append(live)
            node[live] = self.before[e]
            live = live[node[live] != stop[live]]
            step += 1
        sizes = np.zeros(len(unit), np.int64)
        for k, w in enumerate(who):
            sizes[w] = k + 1
        last = np.cumsum(sizes) - 1
        out = np.empty(int(sizes.sum()), np.int64)
        for k, (w, p) in enumerate(zip(who, taken, strict=True)):
            out[last[w] - k] = p
        return out, sizes

    def encode(self, texts: pa.Array, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of texts end to end, their offsets); ``keys`` are 64-bit row keys."""
        for row, data, offsets in slices(texts):
            if len(self.number) > self.known:
                self.forget()
            raw, cuts = data.tobytes(), offsets.tolist()
            units: list[bytes] = []
            counts = [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text = raw[a:b]
                if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
                    units += [u[1:] for u in UNIT.findall(b" " + text)]
                elif text:
                    units += text.split(b" ")
                counts.append(len(units))
            self.learn([u for u in set(units) if u not in self.number])
            which = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
            per = np.diff(counts)
            place = np.arange(len(units)) - np.repeat(counts[:-1], per)
            key = np.repeat(keys[row : row + len(per)], per)
            ids, sizes = self.draw(which, mix(key + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
            ends = np.concatenate(([0], np.cumsum(sizes)))[counts]
            yield row, *self._spelled(ids, ends)

    def _spelled(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.v.bytes)
        long = ids >= n
        if not long.any():
            return ids, ends
        size = np.ones(len(ids), np.int64)
        lengths = np.array([len(x) for x in self.spelling])
        size[long] = lengths[ids[long] - n]
        where = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        flat = np.array([i for x in self.spelling for i in x])
        first = np.cumsum(lengths) - lengths
        at = np.flatnonzero(out >= n)
        out[at] = flat[first[out[at] - n] + at - np.repeat(where[:-1], size)[at]]
        return out, where[ends]


_SAMPLERS: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, alpha: float) -> Sampler:
    """The worker's sampler: reused by all tasks that run in the worker."""
    if (path, alpha) not in _SAMPLERS:
        _SAMPLERS[path, alpha] = Sampler(Vocabulary(path, alpha))
    return _SAMPLERS[path, alpha]


def row_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """A 64-bit key for each row: of its doc_id and the seed alone."""
    known = np.array([0 if i is None else i for i in doc_ids], np.int64).view(np.uint64)
    null = np.array([i is None for i in doc_ids], np.uint64)
    return mix(known + mix(np.full(len(null), seed, np.int64).view(np.uint64)) + null * BASE)


def _encoded(parts: Iterator[pa.RecordBatch], path: str, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        s = sampler(path, alpha)
        doc, text = part.column("doc_id"), part.column("text")
        for row, ids, ends in s.encode(text, row_keys(doc.to_pylist(), seed)):
            n = len(ends) - 1
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [doc.slice(row, n), pa.array(np.diff(ends), pa.int64()), lists]
            yield pa.record_batch(columns, names=["doc_id", "n_pieces", "ids"])


def sample(documents: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids): one sampled segmentation of every whole text.

    A path has probability proportional to its weight to the power ``alpha``. The blank before
    the first word is part of the lattice, as in the library. Signs without a piece are spelled
    in bytes. A null or empty text has no pieces. Rows with the same doc_id and text get the
    same ids; null doc_ids count as one key. An empty table gives no rows.
    """
    encode = partial(_encoded, path=path or public_model(), alpha=alpha, seed=seed)
    return text_columns(documents).mapInArrow(encode, "doc_id long, n_pieces long, ids array<int>")


def _decoded(parts: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        v = sampler(path, ALPHA).v
        out = [None if ids is None else v.decode(ids) for ids in part.column("ids").to_pylist()]
        yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.large_string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids: exactly the texts that were encoded (null as empty)."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path or public_model()), "doc_id long, text string")


def _checked(parts: Iterator[pa.RecordBatch], path: str, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Encode, decode, compare: the digest of each row."""
    for part in parts:
        s = sampler(path, alpha)
        doc, text = part.column("doc_id"), part.column("text")
        for row, ids, ends in s.encode(text, row_keys(doc.to_pylist(), seed)):
            n = len(ends) - 1
            flat, cuts = ids.astype("<u4"), ends.tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            same = [s.v.decode(ids[a:b].tolist()) == (t.as_py() or "") for a, b, t in zip(cuts[:-1], cuts[1:], text.slice(row, n), strict=True)]
            columns = [doc.slice(row, n), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([*columns, lists], names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"])


def sample_checked(documents: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``sample`` with the crc32 of the ids (little-endian, 32 bits) and whether decoding gave the text back."""
    check = partial(_checked, path=path or public_model(), alpha=alpha, seed=seed)
    return text_columns(documents).mapInArrow(check, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>")
