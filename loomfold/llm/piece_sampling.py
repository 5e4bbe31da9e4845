"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text is a lattice of vocabulary pieces. Forward filtering sums the
probability of all paths to each position; backward sampling then draws one
segmentation from the exact posterior, from the end to the start. Every draw
uses a uniform that depends on the row's key, the seed and the position only,
so a row's segmentation is reproducible on any partitioning.

The vocabulary's pieces come from a public model file; a piece's probability
falls with its rank there by Zipf's law, ``(rank + offset) ** -alpha``. As in
the model itself, blanks are part of pieces, one blank is put before a text,
and a character without a piece is spelled in byte pieces. A literal U+2581 is
spelled in bytes too, so decoding returns every text exactly.

The lattice is cut where no piece can cross, mostly before blanks; equal chunks
of a slice share their filtering. Null and empty texts have no pieces and
decode to the empty text. Rows with one key and one text get equal pieces; null
keys share a seed. Very long texts are read whole, piece by piece of the lattice. There
are no ties: a draw that falls on a border takes the next path. An empty table gives no
rows. Of the table only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import mix, slices, utf8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"
_SLICE = 1 << 20


@dataclass
class Vocabulary:
    """A byte trie of the pieces, in a hash table, and what each piece decodes to."""

    keys: np.ndarray
    children: np.ndarray
    piece_at: np.ndarray
    log_p: np.ndarray
    byte_piece: np.ndarray
    joins: np.ndarray
    spelled: np.ndarray
    spelled_from: np.ndarray

    @classmethod
    def load(cls, path: str, alpha: float = 1.0, offset: float = 10.0) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_piece = np.full(256, -1, np.int32)
        spelled, log_p = [b""] * n, np.full(n, -alpha * np.log(n + offset))
        joins = np.zeros((256, 256), bool)
        nodes: dict[tuple[int, int], int] = {}
        piece_of: dict[int, int] = {}
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_piece[int(text[3:5], 16)] = i
                spelled[i] = bytes([int(text[3:5], 16)])
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            spelled[i] = text.replace(_SPACE, " ").encode()
            rank = -sp.get_score(i)
            log_p[i] = -alpha * np.log((rank if rank < n else n) + offset)
            node = 0
            for k, b in enumerate(spelled[i]):
                node = nodes.setdefault((node, b), len(nodes) + 1)
                joins[spelled[i][k - 1], b] |= k > 0
            piece_of[node] = i
        if (byte_piece < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so not every text can be encoded")
        piece_at = np.full(len(nodes) + 1, -1, np.int32)
        piece_at[list(piece_of)] = list(piece_of.values())
        pairs = np.array([(p << 8) | b for p, b in nodes], np.int64)
        size = 1 << (8 * len(pairs) - 1).bit_length()
        keys, children = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left, values, shift = pairs, np.array(list(nodes.values()), np.int32), 0
        while len(left):
            at = (_slot(left, size) + shift) % size
            free = keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            keys[at[put]], children[at[put]] = left[put], values[put]
            left, values, shift = left[~put], values[~put], shift + 1
        lengths = np.array([len(s) for s in spelled])
        return cls(keys, children, piece_at, log_p, byte_piece, joins, np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))

    def child(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; 0 where there is none."""
        want = (nodes.astype(np.int64) << 8) | data
        size = len(self.keys)
        at = _slot(want, size)
        out = np.where(self.keys[at] == want, self.children[at], 0)
        open_ = np.flatnonzero((self.keys[at] != want) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % size
            k = self.keys[at[open_]]
            out[open_[k == want[open_]]] = self.children[at[open_]][k == want[open_]]
            open_ = open_[(k != want[open_]) & (k >= 0)]
        return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(64 - (size - 1).bit_length())
    return ((keys.astype(np.uint64) * _GOLDEN) >> shift).astype(np.int64)


@dataclass
class Lattice:
    """Incoming edges of each position of the distinct chunks, with cumulated posteriors."""

    first: np.ndarray
    source: np.ndarray
    piece: np.ndarray
    upto: np.ndarray


def filtered(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Lattice:
    """Forward filtering over chunks; a chunk of n bytes has positions 0 to n, numbered on through all chunks."""
    n = np.diff(offsets)
    chunk = np.repeat(np.arange(len(n)), n)
    limit = offsets[1:][chunk]
    tail = (data & 0xC0) == 0x80
    live = np.flatnonzero(~tail)
    node = np.zeros(len(live), np.int32)
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    known = np.zeros(len(data), bool)
    start, depth = live, 0
    while len(start):
        node = v.child(node, data[start + depth])
        on = node > 0
        start, node, depth = start[on], node[on], depth + 1
        piece = v.piece_at[node]
        hit = piece >= 0
        edges.append((start[hit], start[hit] + depth, piece[hit]))
        known[start[hit & (size[start] == depth)]] = True
        on = start + depth < limit[start]
        start, node = start[on], node[on]
    # characters without a piece, byte by byte; a chunk may begin within one
    lead = np.maximum.accumulate(np.where(tail, -1, np.arange(len(data))))
    spelled = np.flatnonzero((lead < offsets[:-1][chunk]) | ~known[lead])
    edges.append((spelled, spelled + 1, v.byte_piece[data[spelled]]))
    source, target, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
    own = chunk[source]
    depth_of = target - offsets[own]
    source, target = source + own, target + own  # each chunk has one position more than bytes
    order = np.lexsort((target, depth_of))
    source, target, piece, depth_of = source[order], target[order], piece[order], depth_of[order]
    alpha = np.zeros(len(data) + len(n))
    weight = v.log_p[piece]
    score = np.empty(len(piece))
    new = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    levels = np.searchsorted(depth_of, np.arange(1, (depth_of[-1] if len(depth_of) else 0) + 2))
    new_levels = np.searchsorted(new, levels)
    counts = np.diff(np.append(new, len(target)))
    for k in range(len(levels) - 1):
        a, b = levels[k], levels[k + 1]
        if a == b:
            continue
        heads = new[new_levels[k] : new_levels[k + 1]]
        s = alpha[source[a:b]] + weight[a:b]
        top = np.maximum.reduceat(s, heads - a)
        p = np.exp(s - np.repeat(top, counts[new_levels[k] : new_levels[k + 1]]))
        total = np.add.reduceat(p, heads - a)
        alpha[target[heads]] = top + np.log(total)
        score[a:b] = p / np.repeat(total, counts[new_levels[k] : new_levels[k + 1]])
    run = np.cumsum(score)
    upto = run - np.repeat(run[new] - score[new], counts)
    first = np.zeros(len(data) + len(n), np.int64)
    first[target[new]] = new
    upto[np.append(new[1:], len(target)) - 1] = 2.0  # the last edge takes what is left
    return Lattice(first, source, piece, upto)


def encode_slice(v: Vocabulary, column: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows, and each row's first."""
    data, offsets = utf8(column)
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    cut = np.ones(len(data), bool)
    cut[1:] = ~v.joins[data[:-1], data[1:]]
    cut[offsets[:-1][some]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    own = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    lattice = filtered(v, np.frombuffer(distinct.buffers()[2], np.uint8)[own[0] : own[-1]], own - own[0])
    own = own - own[0] + np.arange(len(own))
    row = np.searchsorted(offsets, starts, "right") - 1
    base = seeds[row] - offsets[row].astype(np.uint64) * _GOLDEN
    out = np.full(len(data), -1, np.int32)
    origin = own[code]
    place = own[code + 1] - 1
    active = np.arange(len(starts))
    while len(active):
        here = place[active]
        at = starts[active] + here - origin[active]
        u = (mix(base[active] + at.astype(np.uint64) * _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = lattice.first[here]
        more = np.flatnonzero(u >= lattice.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= lattice.upto[edge[more]]]
        back = lattice.source[edge]
        out[starts[active] + back - origin[active]] = lattice.piece[edge]
        place[active] = back
        active = active[back > origin[active]]
    used = out >= 0
    upto = np.concatenate([[0], np.cumsum(used)])
    return out[used], upto[offsets]


def decode_slice(v: Vocabulary, ids: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Texts of rows of piece ids, without the blank before each."""
    lengths = np.diff(v.spelled_from)[ids]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    data = v.spelled[np.repeat(v.spelled_from[ids] - upto[:-1], lengths) + np.arange(upto[-1])]
    bounds = upto[firsts]
    some = np.diff(bounds) > 0
    data = np.delete(data, bounds[:-1][some])
    bounds = bounds - np.concatenate([[0], np.cumsum(some)])
    return pa.Array.from_buffers(pa.large_string(), len(firsts) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


@lru_cache(maxsize=2)
def _vocabulary(path: str, alpha: float, offset: float) -> Vocabulary:
    return Vocabulary.load(path, alpha, offset)


def row_seeds(keys: pa.Array, seed: int) -> np.ndarray:
    k = pc.fill_null(keys, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(mix(k + np.uint64(seed)) + np.uint64(0x5851F42D4C957F2D))


def _checksums(ids: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Unsigned crc32 of each row's ids as little-endian 32-bit integers."""
    raw, at = ids.astype("<u4").tobytes(), (4 * firsts).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def _lists(ids: np.ndarray, firsts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, *, seed: int = 0, alpha: float = 1.0, offset: float = 10.0) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens and ids_crc32 for every row; ``path`` names the model file on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path, alpha, offset)
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                ids, firsts = encode_slice(v, part.column("text"), row_seeds(part.column("doc_id"), seed))
                yield pa.record_batch([part.column("doc_id"), _lists(ids, firsts), pa.array(np.diff(firsts)), _checksums(ids, firsts)], names=["doc_id", "ids", "n_tokens", "ids_crc32"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path, 1.0, 10.0)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = part.column("ids")
                firsts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                yield pa.record_batch([part.column("doc_id"), decode_slice(v, lists.flatten().to_numpy().astype(np.int64), firsts)], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, *, seed: int = 0, alpha: float = 1.0, offset: float = 10.0) -> DataFrame:
    """What :func:`encode` gives, with decoded_sha256 and lossless of decoding it again, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path, alpha, offset)
        names = ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                text = pc.fill_null(part.column("text"), "")
                ids, firsts = encode_slice(v, text, row_seeds(part.column("doc_id"), seed))
                back = decode_slice(v, ids.astype(np.int64), firsts)
                digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in back]
                yield pa.record_batch([part.column("doc_id"), _lists(ids, firsts), pa.array(np.diff(firsts)), _checksums(ids, firsts), pa.array(digest, pa.string()), pc.equal(back, text)], names=names)

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean")
