"""Benchmark decontamination under word edits.

Every window of a document is embedded by a CGK random walk over its words: at step j the walk emits the word it stands
on and then moves on or stays by a random bit of (j, word), fresh at each step, so that few edits change few emitted
words and edit distance becomes Hamming distance. Items are taken in classes of nearly equal length, and a class' windows
are as long as its items: keys hash WIDTH emitted words sampled over the steps that such a window lasts. Walks that
stand on one word at the same step go on together, so the windows are walked as groups of neighbouring starts, which
become fewer at each step. For each class, walks and samples are repeated until simulated edits of its items are found
often enough by confirmed candidates. Candidates are confirmed by the exact word edit distance between the item and the best window
that starts there. All positions of whole texts are tried.

The benchmark lies in the shared folder in blocks of about ``BLOCK_ITEMS`` items, whose keys executors make; a worker holds few
of them at a time and the driver none.

Cases: items and documents without words have no match; an item of n words tolerates ``floor(EDITS * n)`` edits, so
short items must occur exactly; very long texts are searched whole; repeated rows are searched each and equal items are
all reported; rows of the benchmark without an id are left out; empty tables give an
empty result; further columns are ignored by name. Case and white space are ignored.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, new_path, table, text_column
from .hashing import distinct, mix, text_chunks, word_hashes
from .stored import load, publish

#: Tolerated edits as a share of an item's words, and the recall that repetitions must reach at that many edits.
EDITS = 0.1
RECALL = 0.99
#: A key hashes WIDTH emitted words, a walk gives TABLES keys a class. Items of a class differ in length by CLASS at most.
WIDTH, TABLES, CLASS = 2, 4, 1.25
#: Steps per word of a window over which emitted words are sampled; a walk takes two steps a word on average.
STEPS = 1.4
#: Edited copies by which the walks of a class are found, and the walks at which that is given up with an error.
SIMULATED, MOST_WALKS = 300, 500
BLOCK_ITEMS = 20_000
_OWN_BITS = 22
_GOLD = 0x9E3779B97F4A7C15


def _bits(symbols: np.ndarray, walk: int, run: int) -> np.ndarray:
    """64 random bits of each word: those of the steps 64 * run to 64 * run + 63 of a walk."""
    return mix(symbols + np.uint64((walk * 1_000_003 + run + 1) * _GOLD % 2**64))


def embed(symbols: np.ndarray, walk: int, starts: np.ndarray, last: np.ndarray, steps: list[int]) -> list[np.ndarray]:
    """The words emitted at the given ascending steps by walks from each start, none of which goes beyond its ``last``."""
    at, out = starts.copy(), []
    for j in range(steps[-1] + 1):
        if j % 64 == 0:
            bits = _bits(symbols, walk, j // 64)
        if j == steps[len(out)]:
            out.append(symbols[at])
            if len(out) == len(steps):
                return out
        at = np.minimum(at + ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), last)
    return out


def embed_all(symbols: np.ndarray, walk: int, steps: list[int], grouped: set[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first starts, emitted words, group of each start) of the groups of starts at each of the ascending steps, walking
    from every place. Groups of starts are numbered at the steps ``grouped`` only, by default at all.

    A move is 0 or 1 and depends on the step and the word alone, so walks never pass each other, and those that meet stay
    together: a group is a run of neighbouring starts. Walks meet ever more rarely, so groups are joined ever more rarely;
    neighbouring groups may stand on one place. The last symbol stands for the end.
    """
    n = len(symbols)
    at, first = np.arange(n), np.arange(n, dtype=np.int32)
    out, due = [], 1
    for j in range(steps[-1] + 1):
        if j % 64 == 0:
            bits = _bits(symbols, walk, j // 64)
        if j % 8 == 0:
            moves = (bits >> np.uint64(j % 64)).astype(np.uint8)
        if j == steps[len(out)]:
            group = None
            if grouped is None or j in grouped:
                begins = np.zeros(n, np.int8)
                begins[first[1:]] = 1
                group = np.cumsum(begins, dtype=np.int32)
            out.append((first, symbols[at], group))
            if len(out) == len(steps):
                return out
        move = moves[at]
        move >>= np.uint8(j % 8)
        move &= np.uint8(1)
        at += move
        if at[-1] == n:
            at[at == n] = n - 1
        if j + 1 >= due:
            due = j + 2 + (j + 1) // 6
            apart = np.empty(len(at), bool)
            apart[0] = True
            np.not_equal(at[1:], at[:-1], out=apart[1:])
            apart = np.flatnonzero(apart)
            at, first = at[apart], first[apart]
    return out


def _samples(walk: int, length: int) -> list[list[int]]:
    """The sampled steps of each key of a walk for windows of ``length`` words."""
    rng = np.random.default_rng([walk, length])
    n = max(1, int(STEPS * length))
    return [np.sort(rng.choice(n, min(WIDTH, n), replace=False)).tolist() for _ in range(TABLES if n > WIDTH else 1)]


def _key(parts: list[np.ndarray], walk: int, length: int, number: int) -> np.ndarray:
    key = np.full(len(parts[0]), (walk * 65536 + length) * 64 + number + 1, np.uint64)
    for part in parts:
        key = (key ^ part) * np.uint64(_GOLD)
        key ^= key >> np.uint64(29)
    return key


def edit_distances(items: list[np.ndarray], which: np.ndarray, text: np.ndarray, at: np.ndarray, until: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least word edit distance between item ``which`` and a start of the text from ``at``, the words of that start), of
    many pairs at once. The text of a pair ends at ``until``.

    Computed in the band of diagonals within a pair's limit; a distance above the limit is given as far above all limits.
    The shortest start wins ties.
    """
    far, most = np.int32(1 << 20), int(limits.max(initial=0))
    out, used = np.full(len(which), far), np.zeros(len(which), np.int64)
    for part in np.array_split(np.argsort([len(items[k]) for k in which], kind="stable"), max(1, len(which) // 4096)):
        if not len(part):
            continue
        sizes = np.array([len(items[k]) for k in which[part]])
        words = np.zeros((len(part), sizes.max()), np.uint64)
        for row, k in zip(words, which[part], strict=True):
            row[: len(items[k])] = items[k]
        room, lim = until[part] - at[part], limits[part][:, None]
        band = np.arange(-most, most + 1)
        edge = np.abs(band)[None] > lim
        above = np.where(band >= 0, band, far)[None] + np.where(edge | (band > room[:, None]), far, 0)
        alive = np.arange(len(part))
        for i in range(1, int(sizes.max()) + 1):
            column = i + band
            place = at[part[alive], None] + np.maximum(column - 1, 0)
            same = text[np.minimum(place, len(text) - 1)] == words[alive, i - 1][:, None]
            best = above + ~same
            best[:, :-1] = np.minimum(best[:, :-1], above[:, 1:] + 1)
            best = np.where(edge[alive] | (column < 0) | (column > room[alive, None]), far, best)
            # Insertions: the least of an earlier cell plus the way from it.
            above = np.minimum.accumulate(best - band, axis=1) + band
            above = np.where(edge[alive] | (column > room[alive, None]), far, above)
            done = sizes[alive] == i
            if done.any():
                rows = part[alive[done]]
                first = above[done].argmin(1)
                out[rows], used[rows] = above[done][np.arange(len(rows)), first], i + band[first]
            go = ~done & (above.min(1) <= lim[alive, 0])
            if not go.all():
                alive, above = alive[go], above[go]
                if not len(alive):
                    break
    return out, used


class _Table:
    """The keys of a class' items for one sample of one walk, with a bit filter before the exact look-up."""

    def __init__(self, steps: list[int], length: int, number: int, keys: np.ndarray, items: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.steps, self.length, self.number, self.keys, self.items = steps, length, number, keys[order], items[order]
        self.shift = np.uint64(64 - max(12, (256 * len(keys)).bit_length()))
        self.filter = np.zeros(1 << int(64 - self.shift), bool)
        self.filter[(keys >> self.shift).view(np.int64)] = True

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``key``, items) of equal keys."""
        hits = np.flatnonzero(self.filter[(key >> self.shift).view(np.int64)])
        lo = np.searchsorted(self.keys, key[hits], "left")
        each = np.searchsorted(self.keys, key[hits], "right") - lo
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(hits, each), self.items[np.repeat(lo, each) + within]


class Benchmark:
    """The items and their keys for the walks that reach the recall."""

    def __init__(self, ids: list[int], words: list[np.ndarray], edits: float = EDITS, recall: float = RECALL):
        order = [k for k in range(len(ids)) if len(words[k])]
        self.ids = [ids[k] for k in order]
        self.words = [words[k] for k in order]
        self.edits = edits
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.limits = np.array([self.limit(n) for n in self.lengths.tolist()], np.int64)
        self.own = np.zeros(1 << _OWN_BITS, bool)
        for k, w in enumerate(self.words):
            self.own[self._slots(w, np.full(len(w), k))] = True
        self.symbols = np.concatenate([np.append(w, np.uint64(0)) for w in self.words]) if self.words else np.zeros(1, np.uint64)
        self.last = np.cumsum(self.lengths + 1) - 1
        self.walks: list[list[_Table]] = []
        least = None
        for n in np.unique(self.lengths).tolist():
            if least is None or n > CLASS * least:
                least = n
                self._add_class(np.flatnonzero((self.lengths >= n) & (self.lengths <= CLASS * n)), n, recall)

    def limit(self, n: int) -> int:
        return int(self.edits * n + 1e-9)

    @staticmethod
    def _slots(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        return (mix(words + item.astype(np.uint64) * np.uint64(_GOLD)) >> np.uint64(64 - _OWN_BITS)).view(np.int64)

    def _copy(self, item: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """An edited copy of an item with other words behind it, as it would lie in a text.

        It has the full number of edits: a third each of replaced, dropped and added words.
        """
        limit, c = self.limit(len(item)), list(item)
        for e in range(limit):
            k = int(rng.integers(len(c)))
            new = np.uint64(rng.integers(1 << 62))
            c[k:k + (e % 3 != 1)] = [] if e % 3 == 2 else [new]
        return np.concatenate([np.array(c, np.uint64), rng.integers(1 << 62, size=len(item) + limit).astype(np.uint64), np.zeros(1, np.uint64)])

    def _add_class(self, items: np.ndarray, length: int, recall: float) -> None:
        """Add walks until edited copies of the items of a class are found often enough.

        At least SIMULATED copies are made, of evenly spaced items or several of each. A copy is found by a hit that
        passes the verification of :meth:`search`; an edit at the front is met from a neighbouring start.
        """
        rng = np.random.default_rng([7, length])
        some = items[:: max(1, len(items) // SIMULATED)]
        of = np.repeat(some, -(-SIMULATED // len(some)))
        copies = [self._copy(self.words[k], rng) for k in of]
        symbols = np.concatenate(copies)
        ends = np.cumsum([len(c) for c in copies])
        begin = ends - [len(c) for c in copies]
        tries = self.limits[of] + 1
        owner = np.repeat(np.arange(len(of)), tries)
        starts = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(tries) - tries, tries)
        left = np.ones(len(of), bool)
        for walk in range(MOST_WALKS):
            if left.sum() <= (1 - recall) * len(of) + 1e-9:
                return
            samples = _samples(walk, length)
            steps = sorted({j for s in samples for j in s})
            emitted = dict(zip(steps, embed(self.symbols, walk, self.last[items] - self.lengths[items], self.last[items], steps), strict=True))
            if walk == len(self.walks):
                self.walks.append([])
            tables = [_Table(s, length, number, _key([emitted[j] for j in s], walk, length, number), items) for number, s in enumerate(samples)]
            self.walks[walk] += tables
            met = dict(zip(steps, embed(symbols, walk, starts, ends[owner] - 1, steps), strict=True))
            for t in tables:
                at, which = t.look_up(_key([met[j] for j in t.steps], walk, length, t.number))
                use = left[owner[at]] & (which == of[owner[at]])
                at, which = at[use], which[use]
                distance, _ = edit_distances(self.words, which, symbols, starts[at], ends[owner[at]] - 1, self.limits[which])
                left[owner[at[distance <= self.limits[which]]]] = False
        raise ValueError(f"recall {recall} isn't reached for items of {length} words and more within {MOST_WALKS} walks")

    def _screen(self, symbols: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of whose first n - limit words at most ``limit`` are foreign to the item, as must be of a match."""
        least = (self.lengths - self.limits)[which]
        misses, limits = np.zeros(len(at), np.int64), self.limits[which]
        for j in range(int((self.lengths - self.limits).max())):
            if not len(at):
                break
            foreign = ~self.own[self._slots(symbols[np.minimum(at + j, len(symbols) - 1)], which)]
            misses += foreign & (j < least)
            ok = misses <= limits
            if not ok.all():
                at, which, misses, limits, least = at[ok], which[ok], misses[ok], limits[ok], least[ok]
        return at, which

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, items) of equal keys, each once."""
        symbols, met = np.append(hashes, np.uint64(0)), []
        for walk, tables in enumerate(self.walks):
            steps = sorted({j for t in tables for j in t.steps})
            groups = dict(zip(steps, embed_all(symbols, walk, steps, {j for t in tables for j in t.steps[1:]}), strict=True))
            for t in tables:
                first, word, _ = groups[t.steps[0]]
                parts = [word, *(later[group[first]] for _, later, group in (groups[j] for j in t.steps[1:]))]
                at, which = t.look_up(_key(parts, walk, t.length, t.number))
                if len(at):
                    # All starts of a group have its key.
                    each = np.append(first[1:], len(hashes))[at] - first[at]
                    each = np.maximum(each, 0)
                    place = np.repeat(first[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    met.append(place.astype(np.int64) * len(self.words) + np.repeat(which, each))
        found = distinct(np.concatenate(met)) if met else np.zeros(0, np.int64)
        return self._screen(symbols, found // len(self.words), found % len(self.words))

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edit distance, first word, words) of the best window of each item in each text."""
        if not len(hashes) or not self.words:
            return []
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        at, which = self.candidates(hashes)
        of = np.searchsorted(ends, at, "right")
        distance, used = edit_distances(self.words, which, hashes, at, ends[of], self.limits[which])
        hits = np.flatnonzero(distance <= self.limits[which])
        for t, k, d, p, n in zip(*(x[hits].tolist() for x in (of, which, distance, at, used)), strict=True):
            best[t, k] = min(best.get((t, k), (d, p, n)), (d, p, n))
        first = ends - counts
        return [(t, k, d, p - int(first[t]), used) for (t, k), (d, p, used) in sorted(best.items())]


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, data, bounds in text_chunks(pa.array(texts, pa.string())):
        hashes, counts = word_hashes(data, bounds)
        out += np.split(hashes, np.cumsum(counts)[:-1])
    return out


def write_benchmark(benchmark: DataFrame, edits: float = EDITS) -> list[str]:
    """Write the items' keys in blocks of about BLOCK_ITEMS items to the shared folder; returns the blocks' paths."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    folder = new_path(benchmark.sparkSession, "benchmark")

    def write(key, rows):
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        bench = Benchmark(rows.column("item_id").to_pylist(), _item_words(rows.column("text").to_pylist()), edits)
        path = f"{folder}/block-{key[0].as_py()}"
        publish(path, [np.frombuffer(pickle.dumps(bench), np.uint8)], [0])
        return pa.table({"path": [path]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    written = materialize(dealt.groupBy("block").applyInArrow(write, "path string"), "benchmark-paths")
    return sorted(r["path"] for r in written.collect())  # one row for each block


@lru_cache(maxsize=2)
def _block(path: str) -> Benchmark:
    return pickle.loads(load(path)[1][0].tobytes())


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edit_distance, first_word, n_words): the best window of each item in each document that has it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = write_benchmark(benchmark, edits)

    def run(batches):
        for batch in batches:
            for i, _, data, bounds in text_chunks(batch.column(1)):
                ids, words = batch.column(0).slice(i, len(bounds) - 1).to_pylist(), word_hashes(data, bounds)
                # Items with an id of their own that are listed twice are reported once, by their best row.
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for path in paths:
                    items = _block(path)
                    for t, k, d, p, used in items.search(*words):
                        best[t, items.ids[k]] = min(best.get((t, items.ids[k]), (d, p, used)), (d, p, used))
                columns = [[ids[t] for t, _ in best], [k for _, k in best], *([v[c] for v in best.values()] for c in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edit_distance", "first_word", "n_words"])

    return rows.mapInArrow(lean(run), "doc_id long, item_id long, edit_distance long, first_word long, n_words long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns."""
    paths, schema, k, text = write_benchmark(benchmark, edits), docs.schema, len(docs.columns), text_column(docs)
    rows = docs if text is not None else docs.select(*docs.columns, F.col("text").cast("string").alias("__text"))
    text = k if text is None else text

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in text_chunks(batch.column(text)):
                clean, words = np.ones(j - i, bool), word_hashes(data, bounds)
                for path in paths:
                    clean[[t for t, *_ in _block(path).search(*words)]] = False
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(part.columns[:k], part.schema.names[:k]).filter(pa.array(clean))

    return rows.mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
