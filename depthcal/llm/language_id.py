"""Language identification in two levels: the language family first, then the languages of that family.

One linear support vector machine for each family, against the rest, picks the family; within it one machine for each
pair of its languages votes. Features are hashed byte n-grams of the whole text with case folded and anything but
letters turned into spaces, so a prediction is a mean of weights. The machines are fitted on at most ``SAMPLE`` labelled
documents, dealt evenly to the languages and chosen by a hash of their id.

Cases: a null text and a text without a letter give ``und`` with score 0; without labelled rows every text does; one
learned language is predicted always; very long texts are counted whole; repeated rows are predicted each, and of a doc_id
with several languages the first by name is learned; an empty table gives an empty result; further
columns are ignored by name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .hashing import text_chunks
from .linear import BUCKETS, count_matrix, fit_svm, fold_case, letters_only, scale_of, sigmoid, sum_weights

#: Labelled documents used for fitting, over all languages.
SAMPLE = 4000
UNKNOWN = "und"

#: Language codes by family. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "indic": "hi ur bn mr ne pa gu",
    "turkic": "tr az kk uz ky",
}


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v.split()), f"_{lang}")


def _prepared(data: np.ndarray) -> np.ndarray:
    return letters_only(fold_case(data))


class LanguageModel:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        """``y`` holds indices into ``langs``."""
        self.langs = langs
        names = [family_of(v) for v in langs]
        self.families = sorted(set(names))
        self.members = [[i for i, f in enumerate(names) if f == g] for g in self.families]
        scale = scale_of(x)
        x = x * scale
        owner = np.array([self.families.index(f) for f in names])[y]
        columns, self.bias = [], []

        def add(rows, sign):
            w, b = fit_svm(x[rows], sign.astype(np.float32))
            columns.append(w * scale)
            self.bias.append(b)

        for g in range(len(self.families)):
            if len(self.families) > 1:
                add(np.arange(len(y)), np.where(owner == g, 1, -1))
        self.pairs = [list(combinations(m, 2)) for m in self.members]
        for pairs in self.pairs:
            for i, j in pairs:
                rows = np.flatnonzero((y == i) | (y == j))
                add(rows, np.where(y[rows] == i, 1, -1))
        self.weights = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((len(scale), 0), np.float32)
        self.bias = np.array(self.bias)

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each text."""
        margin = sum_weights(self.weights, _prepared(data), bounds) + self.bias
        n, k = len(margin), len(self.families) if len(self.families) > 1 else 0
        family, score = np.zeros(n, np.int64), np.ones(n)
        if k:
            family = margin[:, :k].argmax(1)
            score = sigmoid(3 * margin[np.arange(n), family])
        lang, at = np.zeros(n, np.int64), k
        for g, (members, pairs) in enumerate(zip(self.members, self.pairs, strict=True)):
            rows = np.flatnonzero(family == g)
            votes = np.zeros((len(rows), len(members)))
            least = np.full((len(rows), len(members)), np.inf)
            for i, j in pairs:
                m = margin[rows, at]
                a, b = members.index(i), members.index(j)
                # A vote counts one; margins, squeezed below one half, only settle ties.
                votes[:, a] += (m >= 0) + 0.01 * np.tanh(m)
                votes[:, b] += (m < 0) - 0.01 * np.tanh(m)
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
                at += 1
            best = votes.argmax(1)
            lang[rows] = np.array(members)[best]
            if pairs:
                score[rows] *= sigmoid(3 * least[np.arange(len(rows)), best])
        return lang, score


def fit_languages(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """``labelled``: (doc_id, text, lang). At most ``sample`` rows are used, chosen by a hash of doc_id."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # Below a threshold on the hash there are somewhat more than are wanted of a language, however many rows it has.
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * each + 50) / r["n"])) for r in counts], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    few = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("doc_id", "lang").distinct()
    ranked = few.select("doc_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("r"))
    chosen = ranked.where(F.col("r") <= each).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = labelled.select("doc_id", "text", F.col("lang").alias("own")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # One row for each of them, of its own language: repeated ids can't push others out.
    rows = rows.where("own = lang and text is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text", "doc_id")

    def features(batches):
        for batch in batches:
            for i, j, data, bounds in text_chunks(batch.column(1)):
                x = count_matrix(_prepared(data), bounds).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([v[v > 0].tobytes() for v in x], pa.binary()),
                                                  pa.array([np.flatnonzero(v > 0).astype(np.uint16).tobytes() for v in x], pa.binary())], ["lang", "doc_id", "v", "i"])

    found = rows.mapInArrow(features, "lang string, doc_id long, v binary, i binary").collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"]))
    if not found:
        return None
    langs = sorted({r["lang"] for r in found})
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, r in zip(x, found, strict=True):
        row[np.frombuffer(r["i"], np.uint16)] = np.frombuffer(r["v"], np.float16)
    return LanguageModel(langs, x, np.array([langs.index(r["lang"]) for r in found]))


def predict_languages(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score of the column text."""
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def predict(batches):
        for batch in batches:
            texts = batch.column(0)
            for i, j, data, bounds in text_chunks(texts):
                has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[data])])[bounds]) > 0
                for k in np.flatnonzero(~has):
                    has[k] = any(c.isalpha() for c in data[bounds[k]:bounds[k + 1]].tobytes().decode())
                if model is None:
                    names, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                else:
                    lang, score = model.predict(data, bounds)
                    names = [model.langs[v] if ok else UNKNOWN for v, ok in zip(lang, has, strict=True)]
                    score = np.where(has, score, 0.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names), pa.array(score)], [*part.schema.names[1:], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit_languages(docs.where(~held))
    out = predict_languages(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
