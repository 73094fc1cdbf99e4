"""Operators on single texts against brute force: rules, tokens, byte pairs, languages, quality, language model."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depthcal.llm import byte_bpe, elias_fano, hashing, language_id, ngram_lm, quality_classifier, quality_rules, stored, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \n\t", "a", "A b c\nA b c\n\n", "# $ % | < >" * 3, "x" * 3000, "word " * 5000, "líne one\nlíne one\r\n tail", "\U0001f389 漢字 ١٢"]


def prose(seed, n, vocabulary=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Quality rules

def brute_base(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark, docs):
    texts = ODD + [prose(k, 60) for k in range(5)] + [prose(9, 12) + " " + prose(9, 12) + " tail " + prose(9, 12)]
    df = docs(texts).withColumn("kept", F.lit(7)).withColumn("llr", F.lit("clash"))
    trusted = spark.createDataFrame([(10,), (11,), (12,), (10,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality_rules.score_documents(df, trusted).collect()}
    buckets = lambda t: _buckets(spark, t)
    raw, good = collections.Counter(), collections.Counter()
    grams = {i: buckets(t) for i, t in enumerate(texts)}
    for i, g in grams.items():
        raw.update(g)
        if i in (10, 11, 12):
            good.update(g)
    n_raw, n_good, m = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t), i
        llr = [math.log((good[b] + 1) / (n_good + m)) - math.log((raw[b] + 1) / (n_raw + m)) for b in grams[i]]
        assert r["llr"] == pytest.approx(sum(llr) / len(llr) if llr else 0, abs=1e-9)
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality_rules.THRESHOLD)


def _buckets(spark, text):
    row = spark.range(1).select(quality_rules.buckets_of(F.lit(text).cast("string")).alias("b")).first()["b"]
    return [b for b in row if b is not None]


def test_rules_without_trusted_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert all(r["llr"] == 0 for r in quality_rules.score_documents(docs([prose(1, 30), None]), none).collect())
    assert quality_rules.score_documents(docs([]), none).count() == 0
    assert quality_rules.filter_rules(docs([prose(1, 30), None]), none).columns == docs([]).columns


# Token files

def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 300_001):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        out = io.BytesIO()
        control, data = token_files.pack(ranks)
        flat = np.concatenate([*data, np.zeros(3, np.uint8)])
        assert np.array_equal(token_files.unpack(np.concatenate([*control, np.zeros(0, np.uint8)]), flat, n), ranks)
        ids = (ranks % 5000).astype(np.uint32)
        token_files.write_file(out, [None, 7], np.array([n // 2, n - n // 2]), ids)
        out.seek(0)
        doc_ids, lengths, back = token_files.read_file(out)
        assert doc_ids == [None, 7] and lengths.sum() == n and np.array_equal(back, ids)


def test_token_files_match_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = byte_bpe.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ODD + [prose(k, 40) + " Don't STOP; it's <|endoftext|> <|ENDOFTEXT|> Ärger" for k in range(5)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "again"), (None, "no id")]
    df = docs(rows).withColumn("start", F.lit("clash"))
    files = token_files.write_tokens(df, path, file_bytes=4000)
    assert len(files) > 1
    got = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got][1:] == sorted(i for i, _ in rows if i is not None)
    start, left = 0, collections.Counter((i, t) for i, t in rows)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        match = next((i, t) for (i, t), c in left.items() if c and i == r["doc_id"] and tok.encode(t or "", add_special_tokens=False).ids + [1] == ids)
        left[match] -= 1
        assert r["start"] == start and token_files.crc32_of(r["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.write_tokens(docs([]), path) == [] and token_files.read_tokens(spark, []).count() == 0


def test_words_of_more_than_65536_ids():
    path = byte_bpe.tokenizer_file("word_bpe_49k.json")
    enc = token_files.WordEncoder(path)
    for text in ("7" * 70_000, "a b " + "漢字" * 16_000 + " c"):
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(want) > 65_537
        assert np.array_equal(np.concatenate([x for part in enc.encode(pa.array([text, "a b"])) for x in part])[:len(want)], want)


# Byte-level BPE

def test_byte_bpe_matches_the_library(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ODD + ["It's  the\n\n  end\u0085of　it's", "café unbelievably antidisestablishmentarianism", "aaaaaaa abababab xxxxxxxy", "\U0001e4d0\u0870 \U0001e4f0",
                   "".join(rng.choice("abcdefghij") for _ in range(4000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), "=" * 70_000]
    bpe = byte_bpe.production()
    df = docs(texts).withColumn("n_tokens", F.lit(1)).withColumn("data", F.lit("clash"))
    rows = bpe.decode(bpe.encode(df, keep=["doc_id", "n_tokens"])).collect()
    both = bpe.encode(df, keep=["doc_id"], data="data", raw="raw").collect()
    assert sorted((r["doc_id"], r["ids"], r["data"], r["raw"]) for r in rows) == sorted((r["doc_id"], r["ids"], r["data"], r["raw"]) for r in both)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t) and bytes(r["data"]).decode() == t
        assert bytes(r["raw"]) == np.array(r["ids"], "<u4").tobytes()
    assert len(rows) == len(texts)
    assert bpe.decode(bpe.encode(docs([])), data="d").count() == 0


# Language ID

LANGS = {"en": "the of and thing with", "de": "der die und keit nicht schön", "es": "el que ción los niño", "fr": "le que été dans ça avec"}


def sentences(lang, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(30))


def test_language_accuracy_and_odd_texts(spark, docs):
    train = None
    for lang in LANGS:
        df = docs([(1000 * ord(lang[0]) + ord(lang[1]) * 100 + k, sentences(lang, k)) for k in range(30)], lang=lang)
        train = df if train is None else train.union(df)
    model = language_id.fit_languages(train)
    assert model.families == ["germanic", "romance"]
    test = docs([sentences(lang, 99) for lang in LANGS] + ODD).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.predict_languages(test.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == list(LANGS) and all(0 <= r["score"] <= 1 for r in got.values())
    for i, t in enumerate(ODD):
        letters = t is not None and any(c.isalpha() for c in t)
        assert (got[4 + i]["lang_pred"] == "und") == (not letters)
    assert language_id.fit_languages(docs([])) is None
    assert {r["lang_pred"] for r in language_id.predict_languages(test, None, ["doc_id"]).collect()} == {"und"}
    one = language_id.fit_languages(docs([sentences("en", 1), sentences("en", 2)]))
    assert language_id.predict_languages(docs(["abc"]), one, ["doc_id"]).first()["lang_pred"] == "en"


def test_repeated_ids_push_no_language_out(spark, docs):
    train = docs([(1, sentences("en", 1))] * 400)
    for lang in LANGS:
        train = train.union(docs([(100 * ord(lang[0]) + ord(lang[1]) * 1000 + k, sentences(lang, k)) for k in range(10)], lang=lang))
    model = language_id.fit_languages(train, sample=40)
    test = docs([sentences(lang, 99) for lang in LANGS])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(test, model, ["doc_id"]).collect()}
    assert [got[i] for i in range(4)] == list(LANGS)


# Quality classifier

def test_cotraining_separates_held_out_rows(spark, docs):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = prose(k, rng.randrange(30, 90)).split()
        texts.append(" ".join(w + "***" for w in words) if bad else " ".join(words) + ".")
        if k < 120:
            labels.append((k, 0 if bad else 1, 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(texts + ODD).withColumn("kept", F.lit(3)).withColumn("quality_score", F.lit("clash"))
    model = quality_classifier.fit_quality(df, lab)
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score_quality(df, model, ["doc_id"]).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(240)) and len(got) == 240 + len(ODD)
    kept = quality_classifier.filter_quality(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    none = quality_classifier.fit_quality(df, lab.where("false"))
    assert all(r["kept"] for r in quality_classifier.score_quality(df, none, ["doc_id"]).collect())
    assert quality_classifier.score_quality(docs([]), model, ["doc_id"]).count() == 0


def test_cotraining_names_documents_outside_the_sample(spark, docs):
    texts = [prose(k, 60) + "." if k % 4 else " ".join(w + "***" for w in prose(k, 60).split()) for k in range(240)]
    lab = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    df = docs(texts + [(5, "another text")] * 50 + [(200, texts[200])] * 50)
    model = quality_classifier.fit_quality(df, lab, unlabelled=8)
    assert max(model.named) > 8
    got = {(r["doc_id"], r["kept"]) for r in quality_classifier.score_quality(docs(texts), model, ["doc_id"]).collect()}
    assert got == {(k, k % 4 > 0) for k in range(240)}
    assert quality_classifier.LABELLED == quality_classifier.UNLABELLED == 3000


# Language model

def test_elias_fano_access_and_search(tmp_path):
    rng = np.random.default_rng(0)
    for n, universe in ((1, 1), (1, 2**40), (5, 6), (1000, 2**50), (3000, 4000), (2000, 2**64)):
        values = np.sort(rng.choice(universe, n, replace=False) if universe < 10**6 else rng.integers(0, universe, n, np.uint64, endpoint=False)).astype(np.uint64)
        values = np.unique(values)
        m, low, parts = elias_fano.EliasFano.build(values, universe)
        with open(tmp_path / "x", "wb") as f:
            stored.save(f, parts, [m, low])
        (m, low), parts = stored.load(str(tmp_path / "x"))
        ef = elias_fano.EliasFano(m, low, parts)
        assert np.array_equal(ef.get(np.arange(m)), values)
        assert np.array_equal(ef.find(values), np.arange(m))
        other = np.setdiff1d(np.minimum(values + np.uint64(1), np.uint64(universe - 1)), values)
        assert (ef.find(other) == -1).all()
    gaps = np.array([0, 1, 10**6, 10**6 + 1] + list(range(2 * 10**6, 2 * 10**6 + 200)), np.uint64)
    ef = elias_fano.EliasFano(*elias_fano.EliasFano.build(gaps, 3 * 10**6))
    assert np.array_equal(ef.get(np.arange(len(gaps))), gaps)


@pytest.mark.parametrize("pieces", [(1 << 20, 3_000_000), (40, 150)])
def test_scores_match_brute_force(spark, docs, monkeypatch, pieces):
    monkeypatch.setattr(ngram_lm, "WORD_PIECE", pieces[0])
    monkeypatch.setattr(ngram_lm, "PIECE", pieces[1])
    texts = ODD + [prose(k, 80, 60) for k in range(12)]
    train, test = texts[:18], texts
    model = ngram_lm.train(docs(train))
    df = docs(test).withColumn("score", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in ngram_lm.score_texts(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), "\0"]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        one.update(tokens(t))
        two.update(zip(["\0", *tokens(t)], tokens(t), strict=False))
        three.update(zip(["\0", *tokens(t)], tokens(t), tokens(t)[1:], strict=False))
    n, v, kinds = sum(one.values()), len(one), collections.Counter(a for a, _ in two)
    after, kinds_after = collections.Counter(), collections.Counter((a, b) for a, b, _ in three)
    for (a, b, _), c in three.items():
        after[a, b] += c
    for i, t in enumerate(test):
        r, seq, base, score = got[i], tokens(t), 0, 0
        for k, (a, b) in enumerate(zip(["\0", *seq], seq, strict=False)):
            share = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(share)
            second = max(two[a, b] - 0.75, 0) / one[a] + 0.75 * kinds[a] / one[a] * share if one[a] else share
            before = (["\0", *seq][k - 1], a)
            score += math.log10(max(three[*before, b] - 0.75, 0) / after[before] + 0.75 * kinds_after[before] / after[before] * second if k and after[before] else second)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(one[w] > 0 for w in seq), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) <= len(seq) * 4e-4, i


def test_model_of_nothing(spark, docs):
    model = ngram_lm.train(docs([]))
    r = ngram_lm.score_texts(docs(["a b"]), model, ["doc_id"]).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_runs_go_over_batches(monkeypatch):
    """Texts of many batches are looked up together, so searches of the pieces don't grow with the batches."""
    monkeypatch.setattr(ngram_lm, "RUN_TOKENS", 100)
    texts = ["a b c", None, "", "d e"] * 20 + ["x " * 300] + ["f g"] * 5
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i:i + 2], pa.string()), "id": list(range(len(texts)))[i:i + 2]}) for i in range(0, len(texts), 2)]
    runs = list(ngram_lm._runs(batches))
    assert len(runs) == 3  # the second ends with the long text
    assert [k for parts, _, _ in runs for part in parts for k in part.column(0).to_pylist()] == list(range(len(texts)))
    counts = [n for _, _, ends in runs for n in np.diff(ends, prepend=-1).tolist()]
    assert counts == [len((t or "").split()) + 1 for t in texts]
    assert all((tokens[ends] == ngram_lm.END).all() and len(tokens) == ends[-1] + 1 for _, tokens, ends in runs)


def test_word_hashes_follow_words():
    column = pa.array(ODD, pa.string())
    found = []
    for _, _, data, bounds in hashing.text_chunks(column):
        hashes, counts = hashing.word_hashes(data, bounds)
        found += [h.tolist() for h in np.split(hashes, np.cumsum(counts)[:-1])]
    want = [WORD.findall((t or "").translate(LOW)) for t in ODD]
    assert [len(x) for x in found] == [len(x) for x in want]
    pairs = {(w, h) for ws, hs in zip(want, found, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
