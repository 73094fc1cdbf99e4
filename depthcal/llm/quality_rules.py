"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed unigrams and bigrams of lower-cased word and punctuation tokens: one
of the trusted target (documents labelled as good) and one of the whole raw corpus. A document's ratio is divided by
its number of n-grams and held against a fixed threshold, so the verdict is a function of the corpus alone. All
counts cover all documents and all of this module is DataFrame functions.

Cases: a null or blank text has no words and fails the base rules; a document that is only white space has ratio 0;
a very long text is counted whole, as arrays of its words and tokens on its row; repeated rows each count and each get a verdict; without trusted documents the ratio is 0 everywhere and only the
base rules decide; an empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, table, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: Hash buckets of the two multinomials, the smoothing added to each, and the least mean log ratio that is kept.
BUCKETS = 65536
SMOOTHING = 1.0
THRESHOLD = -0.4
#: Trusted ids are broadcast up to this number of rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000

_ANY_SYMBOL = "[" + SYMBOLS.replace("&", "\\&") + "]"
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def repeated_words(words: Column) -> Column:
    """Words inside a window of eight words that occurs at least twice in the text, the first occurrence included.

    Windows are compared by 64-bit hash. Only texts with equal windows are sorted, so the usual cost is one pass.
    """
    n = F.lit(WINDOW)

    def covered(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _positions)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(covered(w))).cast("long")


def _positions(s: Column) -> Column:
    """Sorted (hash, position) pairs to the number of words covered by windows with an equal neighbour."""
    equal = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
    at = F.sort_array(F.transform(equal, lambda x: x["i"]))
    step = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, step, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n")),
                       lambda a: a["n"])


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """The counts of the base rules. ``words`` is a column that holds the words of ``text``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.when(text.rlike(_ANY_SYMBOL), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased word and punctuation tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKENS), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _pair(h: Column, i: Column, all_hashes: Column) -> Column:
    """The bucket of the bigram that begins with a token; null at the last one."""
    after = F.get(all_hashes, i + 1)
    return F.when(after.isNotNull(), _bucket(F.xxhash64(h, after)))


def buckets_of(text: Column) -> Column:
    """Hashed unigrams and bigrams of a text, as bucket numbers; the last bigram is null."""
    return let(token_hashes(text), lambda hs: F.concat(F.transform(hs, _bucket), F.transform(hs, lambda h, i: _pair(h, i, hs))))


def mean_ratio(text: Column, table: Column) -> Column:
    """The mean of the buckets' log ratios over a text's unigrams and bigrams; 0 without any."""
    def mean(hs):
        each = F.transform(hs, lambda h, i: F.get(table, _bucket(h)) + F.coalesce(F.get(table, _pair(h, i, hs)), F.lit(0.0)))
        return F.when(F.size(hs) == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size(hs) - 1))

    return let(token_hashes(text), mean)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row with array ``lr``: log target share less log raw share of each bucket.

    ``docs``: (doc_id, text), all of the raw corpus; ``trusted_ids``: (doc_id) of the trusted target.
    """
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    flagged = docs.join(ids.withColumn("trusted", F.lit(1)), "doc_id", "left")
    grams = flagged.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(buckets_of(F.col("text"))).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    spark = docs.sparkSession
    counts = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left")  # at most BUCKETS rows
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))).alias("c"))
    packed = packed.select("c", F.expr("aggregate(c, 0L, (a, x) -> a + x.raw)").alias("n_raw"), F.expr("aggregate(c, 0L, (a, x) -> a + x.good)").alias("n_good"))
    ratio = (f"ln((x.good + {SMOOTHING}D) / (n_good + {SMOOTHING * BUCKETS}D)) - ln((x.raw + {SMOOTHING}D) / (n_raw + {SMOOTHING * BUCKETS}D))")
    return packed.select(F.expr(f"transform(c, x -> if(n_good = 0, 0D, {ratio}))").alias("lr"))


def score_documents(docs: DataFrame, trusted_ids: DataFrame, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The base counts, base_failed, the ratio and the verdict ``kept`` of every document, with the columns ``keep``.

    ``prefix`` goes before the new columns' names, so that they don't clash with those kept.
    """
    lr = log_ratios(docs.select("doc_id", "text"), trusted_ids)
    extra = [c for c in keep or [] if c != "doc_id"]
    held = docs.select("doc_id", *extra, F.col("text").alias("_text"), words_of(F.col("text")).alias("_words"))
    cols = base_columns(F.col("_text"), F.col("_words"))
    counted = held.select("doc_id", *extra, *[c.alias(prefix + k) for k, c in cols.items()], "_text")
    # The ratios are named once, in a projection of their own: there they stay a constant and don't become a column.
    mean = let(F.col("_lr"), lambda lr_: mean_ratio(F.col("_text"), lr_))
    out = counted.select("*", lr.scalar().alias("_lr")).select("doc_id", *extra, *(prefix + k for k in cols), mean.alias(f"{prefix}llr"))
    n_words = F.col(f"{prefix}n_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PCT * n_words)
    out = out.withColumn(f"{prefix}base_failed", failed)
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}llr") >= THRESHOLD))


def filter_rules(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    scored = score_documents(docs, trusted_ids, docs.columns, "__rule_")
    return scored.where("__rule_kept").select(*docs.columns)


def trusted(labels: DataFrame) -> DataFrame:
    """The trusted target: documents labelled as of good quality and not as toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.round("llr", 9).alias("llr"))
