"""Quality classifier by co-training of two views.

The content view sees hashed byte n-grams of the whole text, the metadata view the page's source and language and the
figures of its layout (lengths, lines, shares of classes of characters). Both are logistic models. They start from a
bounded sample of labelled documents; in each round all unlabelled documents are scored, and each view labels those it
is surest of and hands them to the other, in the proportion of the labels. Each view is then calibrated on labelled documents held out
from training, and the score of every document is the mean of the calibrated log odds, as a probability.

Cases: a null text counts as empty; a null source or language is a value of its own; without labels of both kinds all
scores are 0.5 and everything is kept; very long texts are counted whole; of a doc_id with differing labels the best
counts; repeated rows are scored each, and one of them is fitted on; an empty table gives an empty result; further
columns are ignored by name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, relieve, table, text_column
from .hashing import text_chunks
from .linear import BUCKETS, calibrate, count_matrix, fit_logistic, scale_of, sigmoid, sum_weights

#: Labelled documents used for fitting, unlabelled ones sampled for the scales of the features, the rounds, and the
#: documents named by each view in each round, from all unlabelled ones, as a share of those sampled.
LABELLED = 3000
UNLABELLED = 3000
ROUNDS = 5
SHARE = 0.05
#: How sure a view must be to name a document, and the least score of a kept document.
SURE = 0.95
KEEP = 0.5

_SOURCES, _LANGS = 64, 32
_FIGURES = 12
META = _SOURCES + _LANGS + _FIGURES


def _class_table() -> np.ndarray:
    """Columns: letters and non-ASCII, digits, capitals, spaces, line ends, sentence marks, other marks."""
    t = np.zeros((256, 7), np.uint8)
    for i in range(256):
        c = chr(i)
        if i >= 128 or c.isalpha():
            t[i, 0] = 1
        t[i, 1] = i < 128 and c.isdigit()
        t[i, 2] = i < 128 and c.isupper()
        t[i, 3] = c == " "
        t[i, 4] = c == "\n"
        t[i, 5] = c in ".,;:'\"?"
        t[i, 6] = 32 < i < 127 and not c.isalnum() and c not in ".,;:'\"?"
    return t


_CLASSES = _class_table()


def metadata(data: np.ndarray, bounds: np.ndarray, source: list, lang: list, n_chars: list) -> np.ndarray:
    """The metadata view, one row for each page."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(_CLASSES[:, k][data], dtype=np.int64)])[bounds]) for k in range(7)], 1)
    share = sums / np.maximum(size, 1)[:, None]
    words = sums[:, 3] + sums[:, 4] + 1
    lines = sums[:, 4] + 1
    stated = np.array([np.nan if v is None else float(v) for v in n_chars])
    figures = np.stack([
        *share.T, np.log1p(size) / 10, (size / words) / 10, np.log1p(words / lines) / 5, np.isnan(stated).astype(float),
        np.log1p(np.nan_to_num(np.maximum(stated, 0))) / 10], 1)
    out = np.zeros((n, META), np.float32)
    for k, (values, width, at) in enumerate(((source, _SOURCES, 0), (lang, _LANGS, _SOURCES))):
        for i, v in enumerate(values):
            out[i, at + zlib.crc32(f"{k}:{v}".encode()) % width] = 0.3
    out[:, _SOURCES + _LANGS:] = figures
    return out


class QualityModel:
    """The calibrated models of both views."""

    def __init__(self, labelled: list, others: list, signs: list[int], choose, features):
        """``labelled`` and ``others``: rows of features of documents with (1 good, -1 bad) and without a label.

        ``choose(model, wanted)`` gives the unlabelled documents that a view is surest of for each (view, sign, number,
        ids left out), ``features(ids)`` their rows. A third of the labelled rows only serve for calibration.
        """
        n, quota = len(labelled), max(2, int(SHARE * len(others)))
        y = np.zeros(n + ROUNDS * 2 * (quota + 2), np.int64)
        y[:n] = signs
        self.fitted = (y > 0).sum() >= 3 and (y < 0).sum() >= 3
        if not self.fitted:
            return
        total, both = np.zeros(BUCKETS), [*labelled, *others]
        for r in both:
            total[np.frombuffer(r["i"], np.uint16)] += np.frombuffer(r["v"], np.float16)
        scale = scale_of((total / len(both))[None])
        metas = np.stack([np.frombuffer(r["m"], np.float32) for r in both])
        shift, spread = metas.mean(0), metas.std(0) + 0.05
        views = [np.zeros((len(y), BUCKETS), np.float32), np.zeros((len(y), META), np.float32)]

        def put(at: int, row) -> None:
            i = np.frombuffer(row["i"], np.uint16)
            views[0][at, i] = np.frombuffer(row["v"], np.float16) * scale[i]
            views[1][at] = (np.frombuffer(row["m"], np.float32) - shift) / spread

        for at, row in enumerate(labelled):
            put(at, row)
        del both, metas
        held = np.zeros(len(y), bool)
        for v in (-1, 1):
            held[np.flatnonzero(y == v)[::3]] = True
        known = [np.where(held, 0, y), np.where(held, 0, y)]
        good = (known[0] > 0).sum() / (known[0] != 0).sum()
        models, place = [None, None], {}
        for turn in range(ROUNDS + 1):
            for k in (0, 1):
                rows = np.flatnonzero(known[k])
                models[k] = fit_logistic(views[k][rows], known[k][rows].astype(np.float32))
            self.text = (models[0][0] * scale).astype(np.float32)[:, None], models[0][1]
            self.meta = (models[1][0] / spread).astype(np.float32), models[1][1] - float((shift / spread) @ models[1][0])
            if turn == ROUNDS:
                break
            wanted = [(k, sign, max(1, round(quota * part)), {d for d, at in place.items() if known[1 - k][at]})
                      for k in (0, 1) for sign, part in ((1, good), (-1, 1 - good))]
            named = list(zip(wanted, choose(self, wanted), strict=True))
            new = sorted({d for _, ids in named for d in ids} - set(place))
            for row in features(new) if new else ():
                place[row["doc_id"]] = n + len(place)
                put(place[row["doc_id"]], row)
            for (k, sign, *_), ids in named:
                known[1 - k][[place[d] for d in ids]] = sign
            if not any(ids for _, ids in named):
                break  # later rounds would be the same
        rows = np.flatnonzero(held)
        self.calibration = [calibrate(views[k][rows] @ models[k][0] + models[k][1], y[rows]) for k in (0, 1)]
        self.named = [int(((known[k] != 0) & (y == 0)).sum()) for k in (0, 1)]

    def margins(self, data: np.ndarray, bounds: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        return [sum_weights(self.text[0], data, bounds)[:, 0] + self.text[1], meta @ self.meta[0] + self.meta[1]]

    def score(self, data: np.ndarray, bounds: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(bounds) - 1, 0.5)
        odds = sum(a * m + b for m, (a, b) in zip(self.margins(data, bounds, meta), self.calibration, strict=True)) / 2
        return sigmoid(odds)


_COLUMNS = ["text", "source", "lang", "n_chars"]
_SHAPED = [f"__{c}" for c in _COLUMNS]


def _views(batch, at: int, text: int | None = None):
    """(row range, data, bounds, metadata) of the chunks of a batch whose text columns begin at ``at``; the text may lie at
    ``text``."""
    for i, j, data, bounds in text_chunks(batch.column(at if text is None else text)):
        rest = [batch.column(at + k).slice(i, j - i).to_pylist() for k in (1, 2, 3)]
        yield i, j, data, bounds, metadata(data, bounds, *rest)


def _shape(docs: DataFrame, keep: list[str], again: bool = True) -> DataFrame:
    """The columns ``keep`` and those of the views, without the text if it isn't wanted ``again``."""
    missing = {c: F.lit(None) for c in _COLUMNS if c not in docs.columns}
    docs = docs.withColumns(missing) if missing else docs
    text = F.col("text") if again else F.lit(None)
    return docs.select(*keep, text.cast("string").alias("__text"), F.col("source").cast("string").alias("__source"),
                       F.col("lang").cast("string").alias("__lang"), F.col("n_chars").cast("double").alias("__n_chars"))


def _features(docs: DataFrame, ids: list[int]) -> list:
    """Rows (doc_id, v, i, m) of the features of one row of each of the documents, in the order of doc_id."""
    wanted = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    own = _shape(docs, ["doc_id"]).join(F.broadcast(wanted), "doc_id")
    # Of rows that share an id the one of the least hash counts, as in _surest.
    own = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*_SHAPED).alias("h"), *_SHAPED)).alias("r")).select("doc_id", *(f"r.{c}" for c in _SHAPED))

    def features(batches):
        for batch in batches:
            for i, j, data, bounds, meta in _views(batch, 1):
                x = count_matrix(data, bounds).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([v[v > 0].tobytes() for v in x], pa.binary()),
                     pa.array([np.flatnonzero(v > 0).astype(np.uint16).tobytes() for v in x], pa.binary()),
                     pa.array([v.tobytes() for v in meta], pa.binary())], ["doc_id", "v", "i", "m"])

    found = sorted(own.mapInArrow(lean(features), "doc_id long, v binary, i binary, m binary").collect(), key=lambda r: r["doc_id"])
    relieve(docs.sparkSession, garbage=True)  # collected rows lay in the Java runtime, too
    return found


def _surest(docs: DataFrame, labelled: DataFrame, model: QualityModel, wanted: list) -> list[list[int]]:
    """The documents without a label that a view is surest of, for each (view, sign, number, ids left out) of ``wanted``."""
    rows = _shape(docs.where("doc_id is not null"), ["doc_id"]).select("doc_id", F.xxhash64(*_SHAPED).alias("h"), *_SHAPED)
    # A copy for the workers, without what the fit still holds.
    held = QualityModel.__new__(QualityModel)
    held.text, held.meta = model.text, model.meta

    def run(batches):
        for batch in batches:
            for i, j, data, bounds, meta in _views(batch, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                                                  *(pa.array(np.asarray(m, np.float64)) for m in held.margins(data, bounds, meta))], ["doc_id", "h", "m0", "m1"])

    scored = rows.mapInArrow(lean(run), "doc_id long, h long, m0 double, m1 double").groupBy("doc_id").agg(F.min(F.struct("h", "m0", "m1")).alias("r"))
    scored = materialize(scored.select("doc_id", "r.m0", "r.m1").join(labelled, "doc_id", "left_anti"), "margins")
    least = float(np.log(SURE / (1 - SURE)))
    out = []
    for k, sign, number, without in wanted:
        margin = F.col(f"m{k}") * sign
        top = scored.where(margin >= least).orderBy(margin.desc(), "doc_id").select("doc_id").limit(number + len(without)).collect()
        out.append([r["doc_id"] for r in top if r["doc_id"] not in without][:number])
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> QualityModel:
    """Fit on at most ``labelled`` documents that have a label, by a hash of doc_id, and on those of all others that the
    views name. ``unlabelled`` of the others serve for the scales of the features."""
    ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    have = docs.select("doc_id").where("doc_id is not null").distinct().join(ids, "doc_id", "left")
    chosen = have.where("quality is not null").orderBy(*order).limit(labelled).unionByName(
        have.where("quality is null").orderBy(*order).limit(unlabelled))
    y = {r["doc_id"]: r["quality"] for r in chosen.collect()}  # at most labelled + unlabelled rows
    found = _features(docs, list(y))
    known = [r for r in found if y[r["doc_id"]] is not None]
    others = [r for r in found if y[r["doc_id"]] is None]
    del found
    signs = [1 if y[r["doc_id"]] else -1 for r in known]
    model = QualityModel(known, others, signs, lambda model, wanted: _surest(docs, ids.select("doc_id"), model, wanted), lambda new: _features(docs, new))
    del known, others
    relieve(docs.sparkSession, garbage=True)
    return model


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the quality score and whether the document is kept."""
    rows = _shape(docs, keep)
    k = len(keep)

    def run(batches):
        for batch in batches:
            for i, j, data, bounds, meta in _views(batch, k):
                score = model.score(data, bounds, meta)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k)), pa.array(score), pa.array(score >= KEEP)],
                                                 [*keep, "quality_score", "kept"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:k])
    return rows.mapInArrow(lean(run), f"{kinds}quality_score double, kept boolean")


def filter_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    k = len(docs.columns)
    text = text_column(docs)
    rows = _shape(docs, docs.columns, again=text is None)

    def run(batches):
        for batch in batches:
            for i, j, data, bounds, meta in _views(batch, k, text):
                kept = pa.array(model.score(data, bounds, meta) >= KEEP)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(part.columns[:k], part.schema.names[:k]).filter(kept)

    return rows.mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, ["doc_id"])
