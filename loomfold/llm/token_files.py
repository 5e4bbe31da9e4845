"""Token-id files: tokenised documents in rANS-coded blocks, in doc_id order.

A set of files is a folder with two Parquet tables, so that any store Spark
writes to can hold it and a lost executor's part is written again:

``frequencies``  the shared table: its ``frequency`` array by token id.
``blocks``       one row for each block: ``part`` and ``block`` give the order;
                 ``doc_ids`` and ``lengths`` the documents, whole, in order;
                 ``before`` the part's ids in earlier blocks; ``n_tokens``;
                 ``words``, ``states`` and ``places`` as :mod:`rans` has them;
                 ``words_crc32`` and ``ids_crc32``.

Documents stand in ascending doc_id order, null ids last, repeated ids by their
token ids. A null or empty text has only the end id. An empty table has no
blocks. A block ends with the document that fills it, so a long document makes
one longer block, read and coded whole by one task. Of the table only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rans import Coder, checksum, normalised
from .storage import discard_path, fresh_path
from .textio import LOWER, slices, utf8

#: Ids of a block, about.
BLOCK = 1 << 18
#: Chunks whose ids a worker remembers.
REMEMBERED = 500_000
_SLICE = 1 << 22

_B = np.arange(256)
_LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_BLANK = np.isin(_B, [9, 10, 11, 12, 13, 32])
_OTHER = (_B < 128) & ~_LETTER & ~_DIGIT & ~_BLANK
#: ASCII pairs between which the pre-tokenizer always splits; apostrophes may bind to letters after them.
_SPLIT = np.zeros((256, 256), bool)
_SPLIT[np.ix_(_LETTER, _OTHER | _DIGIT)] = True
_SPLIT[np.ix_(_DIGIT, _LETTER | _DIGIT | _OTHER)] = True
_SPLIT[np.ix_(_OTHER, _DIGIT)] = True
_SPLIT[np.ix_(_OTHER & (_B != 39), _LETTER)] = True
_SPLIT[:, _BLANK] = True
_SPLIT[np.ix_(_BLANK, _BLANK)] = False


#: The normaliser and splitter whose chunks may be encoded apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


class ChunkedTokenizer:
    """The tokenizers library on distinct chunks of text between which its pre-tokenizer always splits.

    Chunks begin with white space or where two ASCII characters never share a
    pre-token. A chunk that is one word of Latin letters is one pre-token and
    goes to the library's model at once; other chunks go through its whole
    pipeline. Texts with the start of a special token are encoded whole, and so
    are all texts where a file has another normaliser or splitter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.chunked = (parts["normalizer"], parts["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER)
        self.special = tuple(t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[bytes, bytes] = {}
        #: Letters that normalisation only lower-cases, one to one.
        self.latin = {chr(c) for c in range(0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.mapped = {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _distinct(self, chunks: list[bytes]) -> list[bytes]:
        """Token ids, as 32-bit words, of chunks that are lower-cased in ASCII."""
        out = [b""] * len(chunks)
        rest = []
        word = self.tokenizer.model.tokenize
        for i, chunk in enumerate(chunks):
            s = chunk.decode().strip(" \n\t\r\v\f")
            if not s.isalpha():
                rest.append(i)
                continue
            if not s.isascii():
                if not self.latin.issuperset(s):
                    rest.append(i)
                    continue
                s = s.lower().encode().decode("latin-1").translate(self.mapped)
            out[i] = array("I", [t.id for t in word(s)]).tobytes()
        for i, ids in zip(rest, self._ids([chunks[i].decode() for i in rest]), strict=True):
            out[i] = ids.tobytes()
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Token ids of each row."""
        if not self.chunked:
            return self._ids([t or "" for t in column.to_pylist()])
        data, offsets = utf8(column)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        raw = data.tobytes()
        whole = {int(np.searchsorted(offsets, i, "right")) - 1 for s in set(self.special) for i in _all(raw, s)}
        data = LOWER[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _SPLIT[data[:-1], data[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        if len(starts):
            bounds = np.append(starts, len(data)).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            found = [self.known.get(c) for c in distinct]
            missing = [i for i, x in enumerate(found) if x is None]
            for i, ids in zip(missing, self._distinct([distinct[i] for i in missing]), strict=True):
                found[i] = ids
                if len(self.known) < REMEMBERED:
                    self.known[distinct[i]] = ids
            code = coded.indices.to_numpy()
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            own = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.frombuffer(b"".join(found), np.uint32)
            each = lengths[code]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(own[code] - upto[:-1], each) + np.arange(upto[-1])]
            rows = upto[np.searchsorted(starts, offsets)]
            out = np.split(ids, rows[1:-1])
        for i in whole:
            out[i] = self._ids([column[i].as_py()])[0]
        return out


def _all(raw: bytes, mark: bytes) -> Iterator[int]:
    i = raw.find(mark)
    while i >= 0:
        yield i
        i = raw.find(mark, i + 1)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(path)


def _tokenised(path: str, end_id: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(path), np.array([end_id], kind)
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                rows = [np.append(ids.astype(kind), end).tobytes() for ids in tokenizer.encode(part.column("text"))]
                yield pa.record_batch([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return run


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                own = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                own[: len(total)] += total
                total = own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


_BLOCKS = (
    "part int, block int, before bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, "
    "words binary, states binary, places binary, words_crc32 bigint, ids_crc32 bigint"
)


def _encoded(shared, kind: str):
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(shared.value), TaskContext.get().partitionId()
        block = before = 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal block, before
            ids = np.concatenate(held)
            code = coder.encode(ids)
            row = [part, block, before, len(ids), docs, [len(h) for h in held], code["words"], code["states"], code["places"], zlib.crc32(code["words"]), checksum(ids)]
            block, before = block + 1, before + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), pa.int64()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        n = 0
        for batch in batches:
            for i, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(i)
                held.append(np.frombuffer(ids.as_buffer(), kind).astype(np.int64))
                n += len(held[-1])
                if n >= BLOCK:
                    yield closed()
                    docs, held, n = [], [], 0
        if held:
            yield closed()

    return run


def write(docs: DataFrame, folder: str, path: str, *, end_id: int = 1) -> None:
    """Tokenise ``docs`` with the tokenizer file ``path`` and write a set of token-id files to ``folder``.

    The token ids are written once in between, as the frequency table needs all
    of them before any block is coded; only ids are shuffled, by doc_id range.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    wide = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) > 1 << 16
    kind = "<u4" if wide else "<u2"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    between = fresh_path(spark, "tokens")
    rows.mapInArrow(_tokenised(path, end_id, wide), "doc_id bigint, ids binary").write.option("compression", "zstd").parquet(between)
    tokens = spark.read.schema("doc_id bigint, ids binary").parquet(between)
    counted = tokens.select("ids").mapInArrow(_counted(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # of the vocabulary's size
    counts = np.zeros(int(counted.id.max()) + 1 if len(counted) else 1, np.int64)
    counts[counted.id] = counted.n
    frequency = normalised(counts)
    spark.createDataFrame([(frequency.tolist(),)], "frequency array<bigint>").coalesce(1).write.parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(frequency)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "ids")
    ordered.mapInArrow(_encoded(shared, kind), _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard_path(spark, between)


def _decoded(shared, with_ids: bool):
    names = ["part", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                b = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if zlib.crc32(b["words"]) != b["words_crc32"]:
                    raise ValueError(f"block {b['part']}/{b['block']} is damaged")
                ids = coder.decode(b["n_tokens"], b["words"], b["states"], b["places"])
                if checksum(ids) != b["ids_crc32"]:
                    raise ValueError(f"block {b['part']}/{b['block']} does not decode to its ids")
                upto = np.concatenate([[0], np.cumsum(b["lengths"])]).astype(np.int64)
                each = [ids[x:y] for x, y in zip(upto[:-1], upto[1:], strict=True)]
                columns = [
                    pa.array([b["part"]] * len(each), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(upto[:-1] + b["before"]), pa.array(b["lengths"], pa.int64()),
                    pa.array([checksum(x) for x in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.record_batch(columns, names=names)

    return run


def read(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in a set of files."""
    frequency = spark.read.parquet(f"{folder}/frequencies").first()[0]
    shared = spark.sparkContext.broadcast(np.array(frequency, np.uint32))  # of the vocabulary's size
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sizes = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())  # one for each part
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    schema = "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    rows = blocks.mapInArrow(_decoded(shared, with_ids), schema)
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint"))
    extra = ["ids"] * with_ids
    return rows.join(starts, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *extra)
