"""Sharding by a minimax contiguous partition of ordered atomic groups.

Texts are dealt to ``n_groups`` atomic groups by a hash of the text, so equal texts are never separated and the
number of group sizes is bounded whatever the corpus holds. Groups too large for an even share come first, each in a
shard of its own; the others follow in order of their number. The smallest feasible capacity is found by binary
search with a greedy check and the sequence is cut there. Everything runs in DataFrame functions.

Cases: a null text counts as empty (8 bytes, checksum 0) and keeps its row; a very long text is one row of its size, and
above an even share has a shard of its own; repeated rows are separate rows with
slots of their own; an empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that each row takes besides its text.
ROW_BYTES = 8

_PEEL = """aggregate(
  slice(by_size, 1, {k} - 1),
  named_struct('rest', total, 'left', {k}, 'n', 0, 'open', true),
  (s, x) -> if(s.open and x.size * s.left > s.rest,
               named_struct('rest', s.rest - x.size, 'left', s.left - 1, 'n', s.n + 1, 'open', true),
               named_struct('rest', s.rest, 'left', s.left, 'n', s.n, 'open', false)))"""

_CAPACITY = """aggregate(
  sequence(1, 63),
  named_struct('lo', greatest(array_max(sizes), cast(ceil(p.rest / p.left) as bigint), 0L), 'hi', greatest(p.rest, 0L)),
  (s, i) -> if(s.lo >= s.hi, s,
    if(aggregate(sizes, named_struct('n', 1, 'fill', 0L),
         (g, x) -> if(g.fill + x <= (s.lo + s.hi) div 2,
                      named_struct('n', g.n, 'fill', g.fill + x),
                      named_struct('n', g.n + 1, 'fill', x)),
         g -> g.n) <= p.left,
       named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2),
       named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi))),
  s -> s.hi)"""

_STARTS = """aggregate(
  sizes,
  named_struct('fill', 0L, 'at', 0, 'starts', cast(array() as array<int>)),
  (g, x) -> if(g.fill + x <= capacity,
               named_struct('fill', g.fill + x, 'at', g.at + 1, 'starts', g.starts),
               named_struct('fill', x, 'at', g.at + 1, 'starts', array_append(g.starts, g.at))),
  g -> g.starts)"""


def _let(name: str, value: str, body: str) -> str:
    """Bind ``value`` to a lambda variable: a column named in a lambda may be evaluated again for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def minimax_cuts(sizes: DataFrame, n_shards: int) -> DataFrame:
    """``sizes``: (grp, size), a bounded number of rows. Returns (grp, shard) by the minimax contiguous partition."""
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("grp", "size"))).alias("all"))
    body = """concat(
      transform(heavy, (g, i) -> named_struct('grp', g, 'shard', i)),
      transform(light, (x, i) -> named_struct('grp', x.grp, 'shard', size(heavy) + size(filter(starts, s -> s <= i)))))"""
    for name, value in (
        ("starts", _STARTS),
        ("capacity", _CAPACITY),
        ("sizes", "transform(light, x -> x.size)"),
        ("light", "filter(all, x -> not array_contains(heavy, x.grp))"),
        ("heavy", "transform(slice(by_size, 1, p.n), x -> -x.grp)"),
        ("p", _PEEL.format(k=n_shards)),
        ("by_size", "sort_array(transform(all, x -> named_struct('size', x.size, 'grp', -x.grp)), false)"),
        ("total", "aggregate(all, 0L, (a, x) -> a + x.size)"),
    ):
        body = _let(name, value, body)
    placed = one.select(F.explode(F.expr(body)).alias("x"))
    return placed.select("x.grp", F.col("x.shard").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 24, n_groups: int = 16384) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes, gapless slots from 0.

    Only ids, sizes and checksums are shuffled. Slots follow the order of storage: rows are numbered within
    (input partition, shard) and offset by the counts of earlier partitions, so no shard is gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(n_groups)).cast("int").alias("grp"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialize(rows, "shard-rows")
    cuts = minimax_cuts(rows.groupBy("grp").agg(F.sum("size").alias("size")), n_shards)
    placed = rows.join(F.broadcast(cuts), "grp").withColumn("part", F.shiftright("rid", 33))  # at most n_groups rows
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part", "shard").orderBy("rid")) - 1
    numbered = placed.withColumn("within", within)
    return numbered.join(counts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents as one folder per shard, in files whose rows are in the order of their slots. ``assigned`` comes
    from :func:`shard_documents` over unique doc_ids. A shard is dealt to tasks by ranges of its slots."""
    (docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
         .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
         .write.mode("overwrite").partitionBy("shard").parquet(path))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
