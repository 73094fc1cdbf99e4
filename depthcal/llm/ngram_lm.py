"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Words are 64-bit hashes. The first level of the trie is the sorted sequence of the hashes of all training words, in
pieces by hash; a word's place in it is its id. The second level holds, context by context, the ids of the words seen
after the context, shifted by the context's range so that the whole level is one monotone sequence, in pieces of
about ``PIECE`` expected pairs that may divide a frequent context. The counts' start of each context is a monotone
pointer sequence, and a pair is found by a successor search relative to its context; its place in the level is its id.
The third level holds in the same way the words seen after each pair, in pieces by the pair's id, which needs no pointer. What is left over for
unseen words is kept with the context, of a divided one in the last piece that begins at or before it. Probabilities are
smoothed by interpolated absolute discounting and kept as 16-bit steps of log10: those of pairs with their share of
the first level, those of triples without that of the second, which scoring has at hand. All levels are files in the
shared folder, which workers map into memory, or read piece by piece from a store that can't be mapped; nothing is read
to the driver but the pieces' names and totals.

Counts are gathered over all training documents: each task merges what it has read and sends packed arrays to the
piece they belong to. Every text is one sequence with an end token; the end also is the context of the first word.

Cases: a null text counts as empty and has its end token only; an unseen word takes the smoothed share of no count;
without training documents every token has that share; a very long text is counted and scored whole; repeated rows
count and are scored each; empty tables give an empty result; further columns are ignored by name. Pairs and triples are
kept in 64 bits: a vocabulary whose square, or whose product with the number of pairs, is beyond it is an error.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, table
from .elias_fano import EliasFano
from .hashing import text_chunks, word_hashes
from .stored import load_cached, publish

#: The end token's hash.
END = np.uint64(0x00E4D00E4D00E4D5)
#: Words and expected pairs of one piece of a level.
WORD_PIECE, PIECE = 1 << 20, 3_000_000
#: Tokens that are looked up together: each piece is searched once for all of them, so the searches of a run, which are as many
#: as the pieces, don't weigh on few tokens. A longer text is a run of its own.
RUN_TOKENS = 1_000_000
#: Discount of pair counts; log10 steps of a stored probability.
DISCOUNT = 0.75
STEPS = 4096.0
_POWERS_OF_TEN = 10.0 ** (-np.arange(65536) / STEPS)
#: The spare share's step of a pair that nothing follows.
_NO_SUCCESSOR = np.uint16(65535)


def _sorted_counts(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts or summed weights."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weight is None:
        x = np.sort(x)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[first], np.diff(np.append(first, len(x)))
    order = np.argsort(x, kind="stable")
    x, weight = x[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.add.reduceat(weight, first)


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences and their counts, compressed."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    raw = np.array([len(values)], "<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(data, "<u8", 1)[0])
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _sequences(column):
    """(rows, hashes with an end after each text, places of the ends) of runs of texts."""
    for i, j, data, bounds in text_chunks(column):
        hashes, counts = word_hashes(data, bounds)
        ends = np.cumsum(counts + 1) - 1
        tokens = np.full(len(hashes) + len(counts), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[ends] = False
        tokens[inside] = hashes
        yield i, j, tokens, ends


def _runs(batches, place: int = 0):
    """(rows without the texts, tokens, places of the ends) of runs of about RUN_TOKENS tokens, over batches; the texts are the
    column at ``place``."""
    held, size = [], 0
    for batch in batches:
        for i, j, tokens, ends in _sequences(batch.column(place)):
            held.append((batch.slice(i, j - i).remove_column(place), tokens, ends + size))
            size += len(tokens)
            if size >= RUN_TOKENS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    return [rows for rows, _, _ in held], np.concatenate([t for _, t, _ in held]), np.concatenate([e for _, _, e in held])


class _Merger:
    """Sorts and counts the values of many runs together, so that a task sends each value at most a few times."""

    def __init__(self, limit: int = 2_000_000):
        self.parts, self.size, self.limit = [], 0, limit

    def add(self, values):
        self.parts.append(values)
        self.size += len(values)
        return self.flush() if self.size > self.limit else None

    def flush(self):
        if not self.parts:
            return None
        out = _sorted_counts(np.concatenate(self.parts))
        self.parts, self.size = [], 0
        return out if len(out[0]) else None


def _blobs(values, counts, pieces):
    """One row for each piece that the sorted values touch; ``pieces`` is monotone."""
    edges = np.flatnonzero(np.concatenate([[True], pieces[1:] != pieces[:-1], [True]]))
    names = pieces[edges[:-1]].astype(np.int64)
    packed = [_pack(values[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["piece", "data"])


def _merge_piece(column) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x) for x in column.to_pylist()]
    return _sorted_counts(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))


class Level1:
    """Words: id, count and share of all training tokens, over the mapped pieces."""

    def __init__(self, folder: str, pieces: list[tuple[int, int, int]], bits: int):
        self.folder, self.bits = folder, bits
        self.first, self.before = {}, {}
        n = total = 0
        for piece, words, tokens in pieces:
            self.first[piece], self.before[piece] = n, total
            n, total = n + words, total + tokens
        self.words, self.tokens = n, total

    def piece(self, p: int) -> tuple[EliasFano, np.ndarray, np.ndarray]:
        """The hashes, counts and sums of counts of a piece."""
        (size, low), (*parts, counts, sums) = load_cached(f"{self.folder}/words-{p}")
        return EliasFano(size, low, parts), counts, sums

    def by_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training tokens of smaller ids, count) of each id."""
        names = list(self.first)
        piece = np.searchsorted(np.array([self.first[p] for p in names]), ids, "right") - 1
        before, counts = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        order = np.argsort(piece, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(piece[order]) != 0, [True]])) if len(ids) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows, p = order[a:b], names[int(piece[order[a]])]
            at = ids[rows] - self.first[p]
            _, count, sums = self.piece(p)
            counts[rows], before[rows] = count[at], sums[at].astype(np.int64) + self.before[p]
        return before, counts

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, training tokens of smaller ids) of each hash."""
        few = _sorted_counts(hashes)[0]
        ids, counts, before = np.full(len(few), -1), np.zeros(len(few), np.int64), np.zeros(len(few), np.int64)
        piece = (few >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(few), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]])) if len(few) else np.zeros(0, np.int64)
        rest = np.uint64((1 << (64 - self.bits)) - 1)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p = int(piece[a])
            if p in self.first:
                sequence, count, sums = self.piece(p)
                at = sequence.find(few[a:b] & rest)
                ok = at >= 0
                ids[a:b] = np.where(ok, at + self.first[p], -1)
                counts[a:b][ok] = count[at[ok]]
                before[a:b][ok] = sums[at[ok]].astype(np.int64) + self.before[p]
        back = np.searchsorted(few, hashes)
        return ids[back], counts[back], before[back]


def piece_of(before: np.ndarray, count: np.ndarray, before_next: np.ndarray, tokens: int, pieces: int) -> np.ndarray:
    """The piece of pairs; monotone in (context, word). Pairs are spread as if words were independent of contexts."""
    place = before + count * (before_next / max(tokens, 1))
    return np.minimum((place * (pieces / max(tokens, 1))).astype(np.int64), pieces - 1)


@lru_cache(maxsize=4)
def _level1(folder: str, pieces: tuple, bits: int) -> Level1:
    return Level1(folder, list(pieces), bits)


def _piece(path: str):
    """The second level's piece: contexts, pointers, successors, steps, spare shares, the first context."""
    (m, m_low, n, n_low, p_low, base), arrays = load_cached(path)
    contexts = EliasFano(m, m_low, arrays[:5])
    pointers = EliasFano(m + 1, p_low, arrays[5:10])
    successors = EliasFano(n, n_low, arrays[10:15])
    return contexts, pointers, successors, arrays[15], arrays[16], base


def _distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order of the elements by value, where each distinct value begins in it and its end, the number of each
    element's value)."""
    order = np.argsort(x)
    begins = np.flatnonzero(np.concatenate([[True], x[order[1:]] != x[order[:-1]]])) if len(x) else np.zeros(0, np.int64)
    back = np.empty(len(x), np.int64)
    back[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x))))
    return order, np.append(begins, len(x)), back


class NgramModel:
    """What a scorer needs to open the mapped levels: names, first ids and totals of the pieces."""

    def __init__(self, folder: str, words: list[tuple[int, int, int]], bits: int, pieces: int, starts: dict[int, int]):
        self.folder, self.word_pieces, self.bits, self.pieces = folder, tuple(words), bits, pieces
        self.present = sorted(starts)
        self.starts = np.array([starts[p] for p in self.present], np.int64)
        self.first_pair, self.pairs, self.piece_pairs, self.triples = np.zeros(len(starts) + 1, np.int64), 0, 1, frozenset()

    def number_pairs(self, sizes: dict[int, int]) -> None:
        """Set the ids of the pairs from the number in each piece."""
        self.first_pair = np.cumsum([0, *(sizes[p] for p in self.present)])
        self.pairs = int(self.first_pair[-1])
        self.piece_pairs = max(1, -(-self.pairs // self.pieces))

    def level1(self) -> Level1:
        return _level1(self.folder, self.word_pieces, self.bits)

    def triple_piece(self, pair: np.ndarray) -> np.ndarray:
        """The piece of the triples that begin with a pair; monotone."""
        return pair // self.piece_pairs

    def score(self, tokens: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Sums by text: tokens, known tokens, log10 of the base and of the model."""
        one = self.level1()
        ids, counts, before = one.look_up(tokens)
        base = np.log10((counts + 0.5) / (one.tokens + 0.5 * (one.words + 1)))
        start = np.concatenate([[0], ends[:-1] + 1])
        pair, scores = self.pair_scores(one, ids, counts, before, start, base)
        scores = self.triple_scores(one, ids, pair, start, scores)
        known = (counts > 0).astype(np.int64)
        return {"n_tokens": np.diff(np.append(start, len(tokens))), "n_known": np.add.reduceat(known, start),
                "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(scores, start)}

    def pair_scores(self, one: Level1, ids, counts, before, start, base) -> tuple[np.ndarray, np.ndarray]:
        """(id of the pair that ends at each token or -1, log10 of the second level) from the tokens' ids, counts and ranks."""
        end_id, end_count, end_before = one.look_up(np.array([END]))
        context, c_before, c_count = np.empty_like(ids), np.empty_like(before), np.empty_like(counts)
        context[1:], c_before[1:], c_count[1:] = ids[:-1], before[:-1], counts[:-1]
        context[start], c_before[start], c_count[start] = end_id[0], end_before[0], end_count[0]
        scores, pair = base.copy(), np.full(len(ids), -1)
        both = np.flatnonzero(context >= 0)  # after an unseen context only the word's own share is known
        if not len(both) or not self.present:
            return pair, scores
        # Each distinct pair, or context of an unseen word, is looked up once.
        order, begins, back = _distinct_of(context[both].astype(np.uint64) * np.uint64(one.words + 1) + (ids[both] + 1).astype(np.uint64))
        token = both[order[begins[:-1]]]
        turn = np.flatnonzero(np.append(True, context[token][1:] != context[token][:-1]))
        own, context_of = context[token][turn], np.repeat(np.arange(len(turn)), np.diff(np.append(turn, len(token))))
        home = np.searchsorted(self.starts, own, "right") - 1
        place = np.full(len(own), -1)
        backoff, span = np.zeros(len(own)), np.zeros((2, len(own)), np.int64)
        for i, rows in _groups(home):
            contexts, pointers, _, _, spare, shift = _piece(f"{self.folder}/pairs-{self.present[i]}")
            at = contexts.find((own[rows] - shift).astype(np.uint64))
            rows, at = rows[at >= 0], at[at >= 0]
            place[rows], backoff[rows] = at, spare[at] / STEPS
            span[0, rows], span[1, rows] = pointers.get(at), pointers.get(at + 1)
        score, number = base[token] - backoff[context_of], np.full(len(token), -1)
        seen = np.flatnonzero(ids[token] >= 0)
        rows = token[seen]
        piece = piece_of(c_before[rows], c_count[rows], before[rows], one.tokens, self.pieces)
        for i, part in _groups(np.searchsorted(self.present, piece)):
            if i >= len(self.present) or self.present[i] != piece[part[0]]:
                continue  # no pair fell into that piece
            contexts, pointers, successors, steps, _, shift = _piece(f"{self.folder}/pairs-{self.present[i]}")
            part = seen[part]
            of = context_of[part]
            at, (first, last) = place[of], span[:, of]
            away = np.flatnonzero(home[of] != i)  # the context goes on in another piece
            if len(away):
                far = own[of[away]] - shift
                at[away] = np.where(far >= 0, contexts.find(np.maximum(far, 0).astype(np.uint64)), -1)
                away = away[at[away] >= 0]
                first[away], last[away] = pointers.get(at[away]), pointers.get(at[away] + 1)
            part, first, last, at = part[at >= 0], first[at >= 0], last[at >= 0], at[at >= 0]
            # The successors of a context are its ids raised by the range of the contexts before it.
            found = successors.find(at.astype(np.uint64) * np.uint64(one.words) + ids[token[part]].astype(np.uint64))
            inside = (found >= first) & (found < last)  # a miss is -1
            score[part[inside]] = -(steps[found[inside]] / STEPS)
            number[part[inside]] = self.first_pair[i] + found[inside]
        scores[both], pair[both] = score[back], number[back]
        return pair, scores

    def triple_scores(self, one: Level1, ids, pair, start, lower) -> np.ndarray:
        """log10 of the third level: the discounted share of a triple, and of the pair's spare share what the second gives."""
        context = np.empty_like(pair)
        context[1:] = pair[:-1]
        context[start] = -1
        rows = np.flatnonzero(context >= 0)
        rows = rows[np.argsort(context[rows])]
        share, spare = np.zeros(len(rows)), np.ones(len(rows))
        piece = self.triple_piece(context[rows])
        edges = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]])) if len(rows) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p = int(piece[a])
            if p not in self.triples:
                continue
            (shift, n, low), (*parts, steps, left) = load_cached(f"{self.folder}/triples-{p}")
            place, word = context[rows[a:b]] - shift, ids[rows[a:b]]
            kept = left[place]
            spare[a:b] = np.where(kept == _NO_SUCCESSOR, 1.0, _POWERS_OF_TEN[kept])
            some = np.flatnonzero((word >= 0) & (kept != _NO_SUCCESSOR))
            # The successors of a pair are their ids raised by the range of the pairs before it.
            found = EliasFano(n, low, parts).find(place[some].astype(np.uint64) * np.uint64(one.words) + word[some].astype(np.uint64))
            share[a + some[found >= 0]] = _POWERS_OF_TEN[steps[found[found >= 0]]]
        out = lower.copy()
        out[rows] = np.log10(share + spare * 10.0 ** lower[rows])
        return out


def _groups(x: np.ndarray):
    """(value, places) of each distinct value."""
    order = np.argsort(x, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) != 0, [True]])) if len(x) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(x[order[a]]), order[a:b]


def train(texts: DataFrame) -> NgramModel:
    """Count and write the three levels over all rows of the column ``text``."""
    spark = texts.sparkSession
    texts = texts.select("text")
    folder = new_path(spark, "ngrams")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Distinct words grow no faster than a twelfth of the bytes; the pieces stay near WORD_PIECE words or below.
    bits = max(0, (size // 12 // WORD_PIECE).bit_length())
    rest = np.uint64((1 << (64 - bits)) - 1)

    def count_words(batches):
        merger = _Merger()
        for batch in batches:
            for _, _, tokens, _ in _sequences(batch.column(0)):
                if done := merger.add(tokens):
                    yield _blobs(*done, done[0] >> np.uint64(64 - bits) if bits else np.zeros(len(done[0])))
        if done := merger.flush():
            yield _blobs(*done, done[0] >> np.uint64(64 - bits) if bits else np.zeros(len(done[0])))

    def write_words(key, rows):
        piece = key[0].as_py()
        values, counts = _merge_piece(rows.column("data"))
        n, low, parts = EliasFano.build(values & rest, 1 << (64 - bits))
        publish(f"{folder}/words-{piece}", [*parts, counts.astype("<u4") if counts.max() < 2**32 else counts, np.cumsum(counts) - counts], [n, low])
        return pa.table({"piece": [piece], "words": [n], "tokens": [int(counts.sum())]})

    counted = texts.mapInArrow(count_words, "piece long, data binary").groupBy("piece").applyInArrow(write_words, "piece long, words long, tokens long")
    words = sorted(tuple(r) for r in materialize(counted, "lm-words").collect())  # one row for each piece
    tokens = sum(r[2] for r in words)
    pieces = max(1, -(-tokens // PIECE))
    word_pieces, vocabulary = tuple(words), sum(r[1] for r in words)
    if not tokens:
        return NgramModel(folder, words, bits, pieces, {})
    if vocabulary >= 1 << 32:
        raise ValueError("pairs of so many words don't fit into 64 bits")

    def count_pairs(batches):
        one = _level1(folder, word_pieces, bits)
        merger = _Merger()
        end = one.look_up(np.array([END]))[0][0]

        def blobs(done):
            first, second = (done[0] // np.uint64(vocabulary)).astype(np.int64), (done[0] % np.uint64(vocabulary)).astype(np.int64)
            return _blobs(*done, piece_of(*one.by_id(first), one.by_id(second)[0], tokens, pieces))

        for _, found, ends in _runs(batches):
            ids = one.look_up(found)[0]
            context = np.empty_like(ids)
            context[1:] = ids[:-1]
            context[np.concatenate([[0], ends[:-1] + 1])] = end
            if done := merger.add(context.astype(np.uint64) * np.uint64(vocabulary) + ids.astype(np.uint64)):
                yield blobs(done)
        if done := merger.flush():
            yield blobs(done)

    def merge_pairs(key, rows):
        codes, counts = _merge_piece(rows.column("data"))
        context = (codes // np.uint64(vocabulary)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        return pa.table({"piece": [key[0].as_py()], "first": [int(context[0])], "last": [int(context[-1])], "n_first": [int(np.append(first, len(context))[1])],
                         "n_last": [int(len(context) - first[-1])], "data": [_pack(codes, counts)]})

    pairs = texts.mapInArrow(count_pairs, "piece long, data binary").groupBy("piece").applyInArrow(
        merge_pairs, "piece long, first long, last long, n_first long, n_last long, data binary")
    pairs = materialize(pairs, "lm-pairs")
    # A context that pieces divide needs its kinds of successors over all of them: only a piece's first and last can be such.
    kinds_of: dict[int, int] = {}
    starts: dict[int, int] = {}
    for r in pairs.drop("data").collect():  # one row for each piece
        starts[r["piece"]] = r["first"]
        kinds_of[r["first"]] = kinds_of.get(r["first"], 0) + r["n_first"]
        if r["last"] != r["first"]:
            kinds_of[r["last"]] = kinds_of.get(r["last"], 0) + r["n_last"]

    def write_level(batches):
        one = _level1(folder, word_pieces, bits)
        for batch in batches:
            for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = _unpack(packed.as_py())
                context, word = (codes // np.uint64(vocabulary)).astype(np.int64), (codes % np.uint64(vocabulary)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                own, kinds = context[first], np.diff(np.append(first, len(context)))
                whole = kinds.copy()
                whole[0], whole[-1] = kinds_of[int(own[0])], kinds_of[int(own[-1])]
                row = np.repeat(np.arange(len(own)), kinds)
                total = one.by_id(own)[1]
                spare = DISCOUNT * whole / total
                share = (one.by_id(word)[1] + 0.5) / (tokens + 0.5 * (vocabulary + 1))
                p = (counts - DISCOUNT) / total[row] + spare[row] * share
                steps = np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.uint16)
                backoff = np.minimum(np.rint(-np.log10(spare) * STEPS), 65535).astype(np.uint16)
                shift = int(own[0])
                m, m_low, contexts = EliasFano.build(own - shift, int(own[-1]) - shift + 1)
                _, p_low, pointers = EliasFano.build(np.append(first, len(codes)), len(codes) + 1)
                n, n_low, successors = EliasFano.build(row.astype(np.uint64) * np.uint64(vocabulary) + word.astype(np.uint64), len(own) * vocabulary)
                publish(f"{folder}/pairs-{piece}", [*contexts, *pointers, *successors, steps, backoff], [m, m_low, n, n_low, p_low, shift])
                yield pa.RecordBatch.from_pydict({"piece": [piece], "n": [n]})

    model = NgramModel(folder, words, bits, pieces, starts)
    written = materialize(pairs.select("piece", "data").mapInArrow(write_level, "piece long, n long"), "lm-level")
    model.number_pairs({r["piece"]: r["n"] for r in written.collect()})  # one row for each piece
    if model.pairs * vocabulary >= 1 << 63:
        raise ValueError("triples of so many pairs and words don't fit into 64 bits")

    def count_triples(batches):
        one, merger = model.level1(), _Merger()

        def blobs(done):
            return _blobs(*done, model.triple_piece((done[0] // np.uint64(vocabulary)).astype(np.int64)))

        for _, found, ends in _runs(batches):
            ids, counts, before = one.look_up(found)
            start = np.concatenate([[0], ends[:-1] + 1])
            pair, _ = model.pair_scores(one, ids, counts, before, start, np.zeros(len(ids)))
            inner = np.ones(len(ids), bool)
            inner[start] = False
            at = np.flatnonzero(inner)
            if done := merger.add(pair[at - 1].astype(np.uint64) * np.uint64(vocabulary) + ids[at].astype(np.uint64)):
                yield blobs(done)
        if done := merger.flush():
            yield blobs(done)

    def write_triples(key, rows):
        codes, counts = _merge_piece(rows.column("data"))
        pair, word = (codes // np.uint64(vocabulary)).astype(np.int64), codes % np.uint64(vocabulary)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        kinds, total = np.diff(np.append(first, len(codes))), np.add.reduceat(counts, first)
        shift = key[0].as_py() * model.piece_pairs
        place = pair - shift
        steps = np.minimum(np.rint(-np.log10((counts - DISCOUNT) / np.repeat(total, kinds)) * STEPS), 65535).astype(np.uint16)
        left = np.full(min(model.piece_pairs, model.pairs - shift), _NO_SUCCESSOR)
        left[place[first]] = np.minimum(np.rint(-np.log10(DISCOUNT * kinds / total) * STEPS), _NO_SUCCESSOR - 1)
        n, low, successors = EliasFano.build(place.astype(np.uint64) * np.uint64(vocabulary) + word, len(left) * vocabulary)
        publish(f"{folder}/triples-{key[0].as_py()}", [*successors, steps, left], [shift, n, low])
        return pa.table({"piece": [key[0].as_py()]})

    triples = texts.mapInArrow(count_triples, "piece long, data binary").groupBy("piece").applyInArrow(write_triples, "piece long")
    model.triples = frozenset(r["piece"] for r in materialize(triples, "lm-triples").collect())  # one row for each piece
    return model


def score_texts(docs: DataFrame, model: NgramModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of the column text."""
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    k = len(keep)

    def run(batches):
        for parts, tokens, ends in _runs(batches):
            s = model.score(tokens, ends)
            yield pa.RecordBatch.from_arrays(
                [*(pa.concat_arrays([part.column(c) for part in parts]) for c in range(k)), pa.array(s["n_tokens"]), pa.array(s["n_known"]),
                 pa.array(np.full(len(ends), model.level1().tokens)), pa.array(s["base_score"]), pa.array(s["score"])],
                [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model = train(docs.where(~held))
    out = score_texts(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
