"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. Equal sets are first merged into one node, so copies cost nothing
further. Each node's set is sketched by exponentially spaced truncated minima (registers ``floor(1 - log_b x)`` of the
least of exponential variates); sketches merge by maximum. Bands of registers name buckets. In each bucket the hub (the
node whose buckets are largest) is paired with the other members, so a group of m near copies costs about m pairs.
Members that are still in different components afterwards are paired by the rarest shingles of their full sets, an
exact bound. Each pair's Jaccard similarity
is first estimated from the registers by maximum likelihood, with a margin of over five deviations, and then confirmed
on the full sets. Components are found by label propagation with pointer jumping over tables in the shared folder.

Cases: a text without words and a null text have an empty set and no link; shorter texts have one shingle; rows that
share a doc_id are one node; a row with a null doc_id is linked with nothing, has a null component and is kept; an
empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_ids, lean, materialize, pick, table
from .hashing import mix, shingle_sets, text_chunks, word_hashes

SHINGLE = 5
#: Registers in bands; at similarity 0.85 a pair shares no band with probability 6e-11, at 0.8 with 1.2e-7.
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
#: SetSketch parameters: spacing of the registers and rate of the variates.
SPACING, RATE, LIMIT = 1.001, 20.0, 65535
#: How far below the threshold an estimate may lie before the pair is left out (a deviation is about 0.026).
MARGIN = 0.14

_A = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    largest = np.empty((len(sets), REGISTERS), np.uint32)
    scratch = np.empty_like(h)
    for i in range(REGISTERS):
        np.multiply(h, _A[i], out=scratch)
        np.add(scratch, _B[i], out=scratch)
        largest[:, i] = np.maximum.reduceat(scratch, at)
    # The largest of uniform variates gives the least of exponential ones.
    least = -np.log((largest + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(SPACING)), 0, LIMIT).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    x = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.zeros((len(registers), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the registers of two sets of known sizes."""
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - plus - minus
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (SPACING - 1) / SPACING) / np.log(SPACING)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return plus * np.log(np.maximum(up, tiny)) + minus * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _features(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j, data, bounds in text_chunks(texts):
            sets = shingle_sets(*word_hashes(data, bounds), SHINGLE)
            full = [k for k, s in enumerate(sets) if len(s)]
            regs = [b""] * len(sets)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                for k, row in zip(full, sketch([sets[k] for k in full]), strict=True):
                    regs[k] = row.tobytes()
                    h1[k] = mix(sets[k]).sum(dtype=np.uint64)
                    h2[k] = mix(sets[k] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)),
                 pa.array(h2.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])


def _band_rows(batches):
    for batch in batches:
        if batch.num_rows:
            regs = np.array([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()])
            for i in range(0, len(regs), 5000):
                keys = band_keys(regs[i:i + 5000])
                ids = np.repeat(batch.column(0).slice(i, len(keys)).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel())], ["id", "key"])


def _likely(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = lambda k: np.array([np.frombuffer(x, np.uint16) for x in batch.column(k).to_pylist()])
                size = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(float)
                ok = estimate(sig(4), sig(5), size(2), size(3)) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(batches):
    for batch in batches:
        for i, j, data, bounds in text_chunks(batch.column(1)):
            sets = shingle_sets(*word_hashes(data, bounds), SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok, last, b = [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _shingle_rows(batches):
    for batch in batches:
        for i, j, data, bounds in text_chunks(batch.column(1)):
            sets = shingle_sets(*word_hashes(data, bounds), SHINGLE)
            sizes = [len(s) for s in sets]
            ids = np.repeat(batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False), sizes)
            marks = np.repeat(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64), sizes)
            n = np.repeat(np.array(sizes, np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks), pa.array(n), pa.array(np.concatenate(sets).view(np.int64))],
                                             ["id", "mark", "n", "s"])


def _rare_pairs(docs: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can be similar, among the open (id, comp).

    Sets that share at least ``percent`` have a common shingle among the rarest ``n - ceil(percent * n / 100) + 1`` of
    each, in any one order of all shingles, and at their first common one enough must be left in both. With the rarest
    first, members of a large group that differ in many places meet nobody. The bounds are exact: no link is lost.
    """
    rows = pick(docs, open_.select("id").distinct()).select("doc_id", "text").mapInArrow(lean(_shingle_rows), "id long, mark long, n long, s long")
    rows = materialize(rows, "near-shingles")
    common = rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    met = rows.join(common, "s")
    each = W.partitionBy("id", "mark")
    met = met.withColumn("alone", F.col("n") - F.count("*").over(each))
    met = met.withColumn("slots", F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1).where("alone < slots")
    met = met.withColumn("pos", F.col("alone") + F.row_number().over(each.orderBy("c", "s"))).where("pos <= slots").select("id", "n", "s", "pos")
    met = materialize(met.join(open_, "id"), "near-prefixes")
    both = met.toDF("a", "n_a", "s", "pos_a", "comp_a").join(met.toDF("b", "n_b", "s", "pos_b", "comp_b"), "s")
    both = both.where("a < b and comp_a <> comp_b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # What can be shared from the first common shingle on.
    both = both.where((100 + percent) * (1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))) >= percent * (F.col("n_a") + F.col("n_b")))
    return both.select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ends of (a, b): comp is the smallest id that can be reached."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.x, "left").select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("at"), F.col("comp").alias("beyond"))
        step = step.join(jump, step.next == jump["at"], "left").select("id", "comp", F.least("next", "beyond").alias("next"))
        step = materialize(step, "labels")
        if step.where("comp <> next").isEmpty():
            return step.select("id", "comp")
        labels = step.select("id", F.col("next").alias("comp"))


def _link_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that hold on the full sets."""
    head = nodes.select("id", "n", "sig")
    both = pairs.join(head.toDF("a", "n_a", "sig_a"), "a").join(head.toDF("b", "n_b", "sig_b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long")
    likely = materialize(likely, f"{name}-likely")
    wanted = materialize(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), f"{name}-wanted")
    sets = materialize(pick(docs, wanted).select("doc_id", "text").mapInArrow(lean(_sets), "id long, set binary"), f"{name}-sets")
    full = likely.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    return materialize(full.mapInArrow(_confirm(percent), "a long, b long"), f"{name}-links")


def _same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the sets of a doc_id that several rows share."""
    twice = materialize(filled.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "near-shared-ids")
    own = filled.join(twice, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "rep").distinct()
    lead = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return materialize(own.join(lead, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "near-id-links")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; linked where 100 * shared >= percent * union."""
    docs = docs.select("doc_id", "text")
    rows = materialize(docs.mapInArrow(lean(_features), "doc_id long, n long, h1 long, h2 long, sig binary"), "near-rows")
    filled = rows.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "near-classes")
    reps = filled.join(classes.select("h1", "h2", F.col("n").alias("m"), "rep"),
                       ["h1", "h2"]).where("n = m and doc_id = rep").select(F.col("doc_id").alias("id"), "n", "sig")
    nodes = materialize(reps.dropDuplicates(["id", "n", "sig"]), "near-nodes")

    bands = materialize(nodes.select("id", "sig").mapInArrow(lean(_band_rows), "id long, key long"), "near-bands")
    sizes = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = bands.join(sizes, "key")
    shared = materialize(shared.select("key", "id", "c"), "near-shared")
    weight = shared.groupBy("id").agg(F.sum("c").alias("w"))
    shared = materialize(shared.join(weight, "id").select("key", "id", "w"), "near-weighted")
    hubs = shared.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("hub")).select("key", (-F.col("hub.m")).alias("hub"))
    pairs = shared.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = _link_pairs(pairs, nodes, docs, percent, "near-first").union(_same_id(filled, classes))
    found = components(links)

    # Buckets in which not all members are in one component yet: their other pairs.
    placed = shared.join(found, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(placed.join(split, "key").select("id", "comp").distinct(), "near-open")
    rest = _rare_pairs(docs, open_, percent).join(materialize(pairs, "near-tried"), ["a", "b"], "left_anti")
    more = _link_pairs(materialize(rest, "near-rest"), nodes, docs, percent, "near-second")
    if not more.isEmpty():
        found = components(links.union(more))

    groups = classes.join(found, classes.rep == found.id, "left").select(
        "h1", "h2", F.col("n").alias("m"), F.coalesce("comp", "rep").alias("component"), "copies", "comp")
    groups = groups.where("copies > 1 or comp is not null").select("h1", "h2", "m", "component")
    out = rows.select("doc_id", "n", "h1", "h2").join(groups, (rows.h1 == groups.h1) & (rows.h2 == groups.h2) & (rows.n == groups.m), "left")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"),
                      F.coalesce(linked == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; of rows that share a doc_id the least by all columns."""
    found = near_duplicates(docs, percent)
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("id")).distinct(), "near-dropped")
    out = docs.join(broadcast_ids(dropped), docs.doc_id == dropped.id, "left_anti")
    twice = out.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select(F.col("doc_id").alias("id"))
    twice = materialize(twice, "near-twice")
    if twice.isEmpty():
        return out
    rest = out.join(broadcast_ids(twice), out.doc_id == twice.id, "left_anti")
    one = out.join(broadcast_ids(twice), out.doc_id == twice.id, "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rest.unionByName(one.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
