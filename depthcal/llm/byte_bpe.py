"""Byte-level BPE in Spark higher-order functions.

Texts are split by the tokenizer's pattern. Each distinct word of the corpus is folded once: its bytes become an array
of ids, and the adjacent pair of least rank is merged until no pair has one, with a literal rank map (rows of the pair
table laid over each other, so that a rank is found by two array accesses). The ids of the distinct words are written
to the shared folder in pieces, sorted by a 64-bit hash of the word. Then each text is split again and its words'
hashes are looked up in those pieces, which workers map into memory; only distinct words and their ids are ever
shuffled. Two words of one hash are noticed when a piece is written, and the hash is replaced. Decoding concatenates
the binary pieces of the ids.

Letters and numbers are those of the library that reads the rank file, whatever Unicode version the Java runtime has.

Cases: a null text counts as empty and gives no ids; a very long text is split whole, and a very long word costs at most
its number of distinct merges times its length between two bytes that no piece joins; repeated rows are encoded each; an empty table gives an empty result;
further columns are kept out by name.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, new_path, relieve, table
from .stored import load_cached, publish

#: Text bytes for each piece of the word table. Its distinct words are far fewer; the number sets the pieces' size only.
PIECE_BYTES = 64 << 20
#: A rank below this is a merge; the pair table gives more than it for pairs that have none.
_NONE = 1 << 16
_ROW = 1 << 17
#: Bytes of a word that is folded as it is, and ids that are appended one by one before they are joined.
SHORT, _STRIP = 64, 256
#: Ids that are decoded at once.
_RUN = 1 << 18


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_merge(ranks: dict[bytes, int], piece: bytes, rank: int) -> list[int]:
    """The two ids that lower merges leave of a piece.

    Between two boundaries that no merge has crossed, a text is merged as the piece alone would be, so no other pair of
    ids ever stands where the piece can be formed.
    """
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        least, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least >= rank:
            raise ValueError(f"{piece!r} doesn't come of merges of lower ranks")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def pair_table(pairs: dict[tuple[int, int], int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each first id's row, entries): ``entries[offset[a] + b] = a * _ROW + rank`` for each pair (a, b).

    Rows are laid over each other where their entries leave room; an entry of another row differs by _ROW or more.
    """
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    offset = np.full(size, -size, np.int64)
    taken, entries = np.zeros(4 * size, bool), np.full(4 * size, -_ROW, np.int64)
    begin: dict[int, int] = {}  # where the last row of as many entries was laid
    for a in sorted(rows, key=lambda k: (-len(rows[k]), k)):
        seconds = np.sort(np.array(rows[a]))
        at = begin.get(len(seconds), 0)
        while True:
            starts = np.arange(at, at + 256)
            fits = np.flatnonzero(~taken[starts[:, None] + (seconds - seconds[0])].any(1))
            if len(fits):
                break
            at += 256
        begin[len(seconds)] = at + int(fits[0])
        offset[a] = at + fits[0] - seconds[0]
        taken[offset[a] + seconds] = True
        entries[offset[a] + seconds] = [a * _ROW + pairs[a, b] for b in seconds.tolist()]
    return offset, entries[: np.flatnonzero(taken).max(initial=-1) + 1]


@lru_cache(maxsize=4)
def _class_gaps(spark_jvm, kind: str) -> str:
    """Ranges of characters that the tokenizer library counts as ``kind`` and the Java runtime doesn't.

    Both are asked for all characters. The library's Unicode version is the later one; a character that only Java
    counts would need a subtraction and is an error.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    library = set(map(ord, bytes(probe.encode_ordinary(every)).decode()))
    java = set(map(ord, spark_jvm.java.util.regex.Pattern.compile(kind.replace("p", "P") + "+").matcher(every).replaceAll("")))
    if java - library:
        raise ValueError(f"the Java runtime counts characters as {kind} that the library doesn't")
    gaps = sorted(library - java)
    cuts = [i for i in range(len(gaps)) if i == 0 or gaps[i] != gaps[i - 1] + 1]
    return "".join(f"\\x{{{gaps[i]:X}}}-\\x{{{gaps[j - 1]:X}}}" for i, j in zip(cuts, [*cuts[1:], len(gaps)], strict=True))


def java_patterns(spark: SparkSession, pattern: str) -> tuple[str, str, str]:
    """(pattern for usual texts, pattern for all texts, class of the characters that make a text unusual)."""
    space = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")
    letters, numbers = (_class_gaps(spark._jvm, k) for k in (r"\p{L}", r"\p{N}"))
    if not letters + numbers:
        return space, space, r"\x{10FFFF}"
    whole = space.replace(r"\p{L}\p{N}]", r"\p{L}\p{N}" + letters + numbers + "]")
    for kind, gaps in ((r"\p{L}+", letters), (r"\p{N}+", numbers)):
        whole = whole.replace(f" ?{kind}", f" ?[{kind[:-1]}{gaps}]+")
    first = min(int(x, 16) for x in (letters + numbers).replace("}", "{").split("{")[1::2])
    return space, whole, f"[\\x{{{first:X}}}-\\x{{10FFFF}}]"


def _literal(value, kind: str) -> Column:
    """A constant of a nested type: parsed once by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        size = max(ranks.values()) + 1
        if size > _NONE:
            raise ValueError("ranks are kept in 16 bits")
        pieces = [b""] * size
        for k, v in ranks.items():
            pieces[v] = k
        self.pool, self.ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
        merges = {tuple(last_merge(ranks, k, v)): v for k, v in ranks.items() if len(k) > 1}
        offset, entries = pair_table(merges, size)
        near = {k[i:i + 2] for k in ranks for i in range(len(k) - 1)}
        first = [ranks[bytes([i])] for i in range(256)]
        inside = [bytes([first.index(a), first.index(b)]) in near for a in range(256) for b in range(256)] if max(first) < 256 else []
        self.rank_map = _literal({"o": offset.tolist(), "e": entries.tolist(), "b": first, "n": inside},
                                 "struct<o:array<bigint>,e:array<bigint>,b:array<bigint>,n:array<boolean>>")

    def split(self, spark: SparkSession, text: Column) -> Column:
        """The matches of the pattern in a text."""
        usual, whole, unusual = java_patterns(spark, self.pattern)
        text = F.coalesce(text.cast("string"), F.lit(""))
        found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
        return found(usual) if usual == whole else F.when(text.rlike(unusual), found(whole)).otherwise(found(usual))

    def fold_word(self, word: Column, t: Column) -> Column:
        """The ids of one word.

        Two bytes that lie side by side in no piece are never merged across, so a long word is folded in the stretches
        between such places; texts without spaces are made of short ones.
        """
        def stretches(p: Column) -> Column:
            apart = F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda i: ~F.coalesce(F.get(t["n"], (F.get(p, i - 1) * 256 + F.get(p, i)).cast("int")), F.lit(True)))
            cut = lambda at: F.transform(at, lambda a, k: F.slice(p, a + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - a))
            return F.flatten(F.transform(let(F.concat(F.array(F.lit(0)), apart), cut), lambda x: self.fold(x, t)))

        latin = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        return let(F.transform(latin, lambda c: F.get(t["b"], F.ascii(c))), lambda p: F.when(F.size(p) <= SHORT, self.fold(p, t)).otherwise(stretches(p)))

    def fold(self, start: Column, t: Column) -> Column:
        """The ids of an array of byte ids: merge the adjacent pair of least rank until no pair has a rank.

        The state holds the ids ``p``, the rank ``r`` of each with its follower, and the least of those. An id is the
        rank of its bytes, so the least rank is the id of the merged pair. All places of that pair are merged at once,
        from the left: ranks rise with length, so none of them can be overtaken by a pair that the merge brings about.
        """
        none = F.lit(2 * _ROW * _NONE)

        def rank(a: Column, b: Column) -> Column:
            # An entry of another row is off by more than any rank.
            return F.coalesce(F.abs(F.get(t["e"], (F.get(t["o"], a.cast("int")) + b).cast("int")) - a * F.lit(_ROW)), none)

        def ranks(p: Column) -> Column:
            return F.zip_with(p, F.slice(p, 2, F.size(p)), rank)

        def state(p: Column, r: Column) -> Column:
            return F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("m"))

        def one(s: Column, at: Column) -> Column:
            """Merge at the place ``at`` (from 1); only the ranks on both sides change."""
            p, r, m = s["p"], s["r"], s["m"]
            left = F.when(at > 1, F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), F.array(rank(F.get(p, at - 2), m)))).otherwise(F.array().cast("array<bigint>"))
            right = F.array(rank(m, F.get(p, at + 1)))
            merged = F.concat(F.slice(p, 1, at - 1), F.array(m), F.slice(p, at + 2, F.size(p)))
            return let(F.concat(left, right, F.slice(r, at + 2, F.size(p))), lambda new: state(merged, new))

        def many(s: Column, at: Column) -> Column:
            p, r, m = s["p"], s["r"], s["m"]
            marked = F.transform(p, lambda x, i: F.when(F.get(r, i) == m, m).when(F.get(r, i - 1) == m, F.lit(-1)).otherwise(x))
            # Places of a pair of equal ids may overlap: every other one of a run counts.
            empty = F.array().cast("array<bigint>")
            held = lambda o, skip: F.struct(o.alias("o"), skip.alias("skip"))
            place = lambda a, i: F.when(a["skip"], held(a["o"], F.lit(False))).otherwise(
                held(F.array_append(a["o"], F.when(F.get(r, i) == m, m).otherwise(F.get(p, i))), F.get(r, i) == m))
            run = lambda a, k: F.aggregate(F.sequence(k * _STRIP, F.least((k + 1) * _STRIP, F.size(p)) - 1), held(empty, a["skip"]), place)
            greedy = F.aggregate(F.sequence(F.lit(0), ((F.size(p) - 1) / _STRIP).cast("int")), held(F.array(empty), F.lit(False)),
                                 lambda a, k: let(run(a, k), lambda x: held(F.array_append(a["o"], x["o"]), x["skip"])), lambda a: F.flatten(a["o"]))
            merged = F.when(F.get(p, at - 1) == F.get(p, at), greedy).otherwise(F.array_remove(marked, -1))
            return let(merged, lambda q: let(ranks(q), lambda new: state(q, new)))

        def merge(s: Column) -> Column:
            def placed(at):
                return F.when(F.size(F.array_remove(s["r"], s["m"])) + 1 == F.size(s["r"]), one(s, at)).otherwise(many(s, at))

            return let(F.array_position(s["r"], s["m"]).cast("int"), placed)

        begun = let(ranks(start), lambda r: state(start, r))
        return F.aggregate(start, begun, lambda s, _: F.when(s["m"] < _NONE, merge(s)).otherwise(s), lambda s: s["p"])

    def word_ids(self, texts: DataFrame) -> DataFrame:
        """(word, ids) of every distinct word of the column ``text``."""
        words = texts.select(F.explode(self.split(texts.sparkSession, F.col("text"))).alias("word")).distinct()
        return words.select("word", let(self.rank_map, lambda t: self.fold_word(F.col("word"), t)).alias("ids"))

    def write_words(self, texts: DataFrame) -> tuple[str, int, int]:
        """Write the table of words; returns its folder, the bits of the hash that name a piece, and the hash's seed."""
        spark = texts.sparkSession
        # Plans hold the literals; without a limit their texts would fill the driver.
        spark.conf.set("spark.sql.maxPlanStringLength", "100000")
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(1, (size // PIECE_BYTES).bit_length())
        for seed in range(64):
            folder = new_path(spark, "bpe-words")
            rows = self.word_ids(texts).select(_hash(F.col("word"), seed).alias("h"), F.col("ids").cast("array<int>").alias("ids"))
            rows = rows.withColumn("piece", F.shiftrightunsigned("h", 64 - bits))
            written = rows.groupBy("piece").applyInArrow(_piece_writer(folder, bits), "piece long, clashes long")
            if not written.agg(F.sum("clashes")).first()[0]:
                return folder, bits, seed
        raise ValueError("two words have the same hash for each seed")

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None, data: str | None = None, raw: str | None = None) -> DataFrame:
        """``docs``, or its columns ``keep``, with the array of ids of the column ``text`` added.

        With ``data`` and ``raw`` the ids are decoded at once, as :meth:`decode` does, by the same worker.
        """
        keep = docs.columns if keep is None else keep
        folder, bits, seed = self.write_words(docs.select(F.col(text).cast("string").alias("text")))
        relieve(docs.sparkSession, garbage=True)  # plans with the rank map have been compiled and sent
        words = F.transform(self.split(docs.sparkSession, F.col(text)), lambda w: _hash(w, seed))
        rows = docs.select(*(F.col(f"`{c}`") for c in keep), words.alias("__hashes"))
        more = {ids: F.array().cast("array<int>")} | ({data: F.lit(b""), raw: F.lit(b"")} if data else {})
        k, schema = len(keep), docs.select(*(F.col(f"`{c}`") for c in keep)).withColumns(more).schema
        pool, ends = self.pool, self.ends

        def run(batches):
            for batch in batches:
                hashes = batch.column(k)
                edges = hashes.offsets.to_numpy().astype(np.int64)
                at, values = look_up(folder, bits, hashes.values.to_numpy()[edges[0]:edges[-1]])
                at = at[edges - edges[0]]
                for i, j in _runs(at):
                    own, edge = values[at[i]:at[j]], at[i:j + 1] - at[i]
                    found = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(own, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:k], found, *(_decoded(pool, ends, own, edge) if data else [])], schema.names)

        return rows.mapInArrow(run, schema)

    def decode(self, docs: DataFrame, ids: str = "ids", data: str = "data", raw: str = "raw", keep: list[str] | None = None) -> DataFrame:
        """``docs``, or its columns ``keep``, with two binary columns more: the bytes that the ids stand for, which are
        the ids' pieces one after the other, and the ids themselves as little-endian unsigned 32-bit integers."""
        keep = docs.columns if keep is None else keep
        k, pool, ends = len(keep), self.pool, self.ends
        rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
        schema = docs.select(*(F.col(f"`{c}`") for c in keep)).withColumns({data: F.lit(b""), raw: F.lit(b"")}).schema

        def run(batches):
            for batch in batches:
                column = batch.column(k)
                at = column.offsets.to_numpy().astype(np.int64)
                values = column.values.to_numpy()
                for i, j in _runs(at):
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:k], *_decoded(pool, ends, values[at[i]:at[j]], at[i:j + 1] - at[i])], schema.names)

        return rows.mapInArrow(run, schema)


def _runs(at: np.ndarray):
    """Runs (first, behind the last) of documents of about _RUN ids, whose places are ``at``; a longer document is alone."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _RUN, "right")) - 1)
        yield i, j
        i = j


def _decoded(pool: np.ndarray, ends: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """The joined pieces of the ids between the edges, and the ids as bytes."""
    size = ends[ids] - np.where(ids > 0, ends[ids - 1], 0)
    place = np.concatenate([[0], np.cumsum(size)])
    joined = pool[np.repeat((ends[ids] - size - place[:-1]).astype(np.int32), size) + np.arange(int(place[-1]), dtype=np.int32)]
    return [_binary(joined, place[edges]), _binary(ids.astype("<u4").view(np.uint8), 4 * edges)]


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes between the edges, one value each."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _hash(word: Column, seed: int) -> Column:
    return F.xxhash64(word) if seed == 0 else F.xxhash64(word, F.lit(seed))


def _piece_writer(folder: str, bits: int):
    """Writes a piece of the word table: hashes in order, a jump table on their next bits, ends of the ids, the ids."""
    def write(key, rows):
        rows = rows.combine_chunks()
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        clashes = int((h[1:] == h[:-1]).sum())
        ids = rows.column("ids").combine_chunks()
        edges = ids.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(edges)[order]
        ends = np.cumsum(sizes)
        pool = ids.values.to_numpy()[np.repeat(edges[:-1][order] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        jump_bits = max(1, len(h).bit_length())
        jump = np.searchsorted((h << np.uint64(bits)) >> np.uint64(64 - jump_bits), np.arange((1 << jump_bits) + 1, dtype=np.uint64))
        publish(f"{folder}/words-{key[0].as_py()}", [h, jump.astype(np.uint32), np.append(0, ends), pool.astype(np.uint16)], [jump_bits])
        return pa.table({"piece": [key[0].as_py()], "clashes": [clashes]})

    return write


def look_up(folder: str, bits: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word's first id and of the end, all ids) of words by their hashes."""
    h = hashes.view(np.uint64)
    first, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    piece = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(piece, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(piece[order]) != 0, [True]])) if len(h) else [0]
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        (jump_bits,), (keys, jump, ends, pool) = load_cached(f"{folder}/words-{int(piece[rows[0]])}")
        own = h[rows]
        at = jump[((own << np.uint64(bits)) >> np.uint64(64 - jump_bits)).astype(np.int64)].astype(np.int64)
        open_ = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] < own)
        while len(open_):
            at[open_] += 1
            open_ = open_[keys[np.minimum(at[open_], len(keys) - 1)] < own[open_]]
            open_ = open_[at[open_] < len(keys)]
        if (at >= len(keys)).any() or (keys[at] != own).any():
            raise ValueError("a word isn't in the table; the texts have changed meanwhile")
        first[rows], size[rows] = ends[at], ends[at + 1] - ends[at]
        parts.append((rows, pool))
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(place[-1]), np.int32)
    for rows, pool in parts:
        n = size[rows]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(place[rows], n) + within] = pool[np.repeat(first[rows], n) + within]
    return place, out


def production(path: str | None = None) -> ByteBpe:
    """The codec of the public 50k rank file, or of another rank file with the same pattern."""
    import public_tokenizers

    return ByteBpe(read_ranks(path or tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    docs = production().encode(table(spark, sf_dir, "documents"), keep=["doc_id"], data="data", raw="raw")
    return docs.select("doc_id", (F.octet_length("raw") / 4).cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"),
                       F.sha2("data", 256).alias("decoded_sha256"))
