"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Documents are range-partitioned by doc_id, encoded, and each partition is written as one file. Within a file ids are
replaced by their rank of frequency, so that the commonest 256 take one byte; the rank table is stored in the file.
Two bits for each rank give its length in bytes; four of them make a control byte, control bytes are stored apart
from the data, and a decoder finds lengths, offsets and masks of four ranks by table lookup on the control byte.

File: ``MAGIC``; four little-endian u64: documents, ids, ranks, data bytes; doc_id i64 and a validity byte for each
document; ids of each document u32; the rank table u32; control bytes; data bytes and three bytes of padding.

Cases: a null text counts as empty and has the end id only; rows with a null doc_id come first and repeated ids follow
each other in the order of (checksum of the text, storage); an empty table gives no file and an empty result; further
columns are ignored by name.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, open_uri, rename_uri, table
from .hashing import distinct, mix, span_hashes, text_chunks, word_spans

MAGIC = b"FRVB0001"
END_ID = 1
#: Text bytes that go to one file, and words whose ids a worker remembers (a cache only; then it starts afresh).
FILE_BYTES = 16 << 20
CACHED_WORDS = 1_500_000
#: Control bytes decoded at once.
_BLOCK = 1 << 16

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_LENGTHS = (_CODES + 1).astype(np.int64)
_TOTALS = _LENGTHS.sum(axis=1)
_OFFSETS = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_LENGTHS, axis=1)[:, :3]], axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[_CODES]


def pack(ranks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Control bytes and data bytes of unsigned ranks, in blocks. The last control byte is filled up with ranks of one byte."""
    controls, data = [], []
    for i in range(0, len(ranks), 4 * _BLOCK):
        block = ranks[i:i + 4 * _BLOCK].astype(np.uint32)
        block = np.append(block, np.zeros(-len(block) % 4, np.uint32))
        codes = (block > 0xFF).astype(np.uint8) + (block > 0xFFFF) + (block > 0xFFFFFF)
        quads = codes.reshape(-1, 4)
        controls.append((quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8))
        at = np.cumsum(codes.astype(np.int64) + 1)
        out = np.zeros(at[-1], np.uint8)
        at -= codes + 1
        for k in range(int(codes.max()) + 1):
            use = np.flatnonzero(codes >= k)
            out[at[use] + k] = (block[use] >> (8 * k)) & 0xFF
        # Of the filling only the control bits stay; its data bytes are zero and belong to no id.
        data.append(out)
    return controls, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks. ``data`` must have three bytes of padding behind its end."""
    words = np.ndarray((max(len(data) - 3, 0),), "<u4", data, 0, (1,))
    out, at = np.empty(len(control) * 4, np.uint32), 0
    for i in range(0, len(control), _BLOCK):
        c = control[i:i + _BLOCK]
        sizes = _TOTALS[c]
        starts = at + np.cumsum(sizes) - sizes
        out[4 * i:4 * (i + len(c))] = (words[starts[:, None] + _OFFSETS[c]] & _MASKS[c]).ravel()
        at += int(sizes.sum())
    return out[:n]


def write_file(stream, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    order = np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)].astype(np.uint32)
    rank = np.zeros(len(counts), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    controls, data = pack(rank[ids])
    stream.write(MAGIC + np.array([len(doc_ids), len(ids), len(order), sum(map(len, data))], "<u8").tobytes())
    stream.write(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    stream.write(np.array([x is not None for x in doc_ids], np.uint8).tobytes())
    for part in (lengths.astype("<u4"), order.astype("<u4"), *controls, *data, np.zeros(3, np.uint8)):
        stream.write(part.tobytes())


def read_file(stream) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    raw = stream.read()
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, ranks, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    parts = []
    for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", ranks), ("u1", -(-n // 4)), ("u1", size + 3)):
        parts.append(np.frombuffer(raw, kind, k, at))
        at += parts[-1].nbytes
    doc_ids = [int(x) if ok else None for x, ok in zip(parts[0], parts[1], strict=True)]
    return doc_ids, parts[2].astype(np.int64), parts[3][unpack(parts[4], parts[5], n)]


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words; each distinct
    word is encoded once as long as the worker remembers it. Words are found by a 64-bit hash, their length and their
    first eight bytes together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.keys, self.marks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at, self.size, self.pool = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, self.kind)

    def encode(self, column) -> Iterator[list[np.ndarray]]:
        """The ids of each text of an Arrow column, in lists as long as the runs of texts worked on."""
        for _, _, data, bounds in text_chunks(column):
            # The tokenizer lower-cases; only the strings of special tokens depend on case, and they hold this pair.
            data = data if b"<|" in data.tobytes() else _LOWER[data]
            starts, ends, counts = word_spans(data, bounds)
            hashes = span_hashes(data, starts, ends, fold=False)
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            heads = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[starts]
            length = ends - starts
            short = length < 8
            heads[short] &= (np.uint64(1) << (length[short] * 8).astype(np.uint64)) - np.uint64(1)
            marks = (mix(heads + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
            self._learn(data, starts, ends, hashes, marks)
            where = self._find(hashes, marks)
            at, sizes, pool = self.at[where].astype(np.int64), self.size[where].astype(np.int64), self.pool
            for i in np.flatnonzero(where < 0):  # another word has its hash
                own = self.tokenizer.encode(data[starts[i]:ends[i]].tobytes().decode(), add_special_tokens=False).ids
                at[i], sizes[i], pool = len(pool), len(own), np.append(pool, np.array(own, self.kind))
            ids = pool[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            yield [np.append(ids[a:b], self.kind(END_ID)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _find(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Places in the memory, -1 where a word isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        few = distinct(hashes)
        place = np.searchsorted(self.keys, few)[np.searchsorted(few, hashes)]
        place[place == len(self.keys)] = 0
        return np.where((self.keys[place] == hashes) & (self.marks[place] == marks), place, -1)

    def _learn(self, data, starts, ends, hashes, marks) -> None:
        missing = np.flatnonzero(self._find(hashes, marks) < 0)
        if len(self.keys) + len(missing) > CACHED_WORDS:
            self._forget()
            missing = np.arange(len(hashes))
        keys, first = np.unique(hashes[missing], return_index=True)
        if not len(keys):
            return
        new = missing[first]
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        flat, owner = [], []
        groups = [words[i:i + 64] for i in range(0, len(words), 64)]
        for i, e in enumerate(self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
            flat.append(np.array(e.ids, self.kind))
            owner.append(np.array(e.word_ids, np.int64) + 64 * i)
        sizes = np.bincount(np.concatenate(owner).astype(np.int64), minlength=len(words))
        at = len(self.pool) + np.cumsum(sizes) - sizes
        place = np.searchsorted(self.keys, keys)
        self.keys, self.marks = np.insert(self.keys, place, keys), np.insert(self.marks, place, marks[new])
        self.at, self.size = np.insert(self.at, place, at.astype(np.uint32)), np.insert(self.size, place, sizes.astype(np.uint32))
        self.pool = np.concatenate([self.pool, *flat])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """Write the documents' ids in ascending doc_id order; returns (path, ids in the file) in that order."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    folder = new_path(spark, "tokens")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("rid"))
    # The whole key splits a doc_id that many rows share.
    ordered = ordered.repartitionByRange(max(1, -(-size // file_bytes)), F.asc_nulls_first("doc_id"), "h", "rid")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "rid").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(tokenizer_path)
        doc_ids, ids = [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for part in enc.encode(batch.column(1)):
                ids += part
        if not doc_ids:
            return
        lengths = np.array([len(x) for x in ids])
        path = f"{folder}/part-{task.partitionId():06d}.frvb"
        passing = f"{path}.{task.taskAttemptId()}"
        with open_uri(passing, "wb") as stream:
            write_file(stream, doc_ids, lengths, np.concatenate(ids))
        rename_uri(passing, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [int(lengths.sum())]})

    written = materialize(ordered.mapInArrow(write, "path string, n long"), "token-paths")
    return sorted((r["path"], r["n"]) for r in written.collect())  # one row for each file


def read_tokens(spark, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, ids) of every document of the files, ids as little-endian unsigned 32-bit integers."""
    starts, n = [], 0
    for path, k in files:
        starts.append((path, n))
        n += k

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_uri(path, "rb") as stream:
                    doc_ids, lengths, ids = read_file(stream)
                ids = ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                for i in range(0, len(doc_ids), 1000):
                    j = min(i + 1000, len(doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[i:j], pa.int64()), pa.array(start + at[i:j], pa.int64()),
                         pa.array([ids[a:b].tobytes() for a, b in zip(at[i:j], at[i + 1:j + 1], strict=True)], pa.binary())],
                        ["doc_id", "start", "ids"])

    paths = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(files)))
    return paths.mapInArrow(read, "doc_id long, start long, ids binary")


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data)


def query(spark, sf_dir: str) -> DataFrame:
    from .byte_bpe import tokenizer_file

    files = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    rows = read_tokens(spark, files)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
