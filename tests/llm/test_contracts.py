"""The registered queries over the smallest tables: columns, types and values that the contracts fix."""

import base64
import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pytest
from test_texts import LOW, WORD, brute_base

from depthcal.llm import byte_bpe, common
from depthcal.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}


def run(spark, name, kinds):
    df = q.QUERIES[name](spark, SF)
    assert df.dtypes[:len(kinds)] == [tuple(k.split(":")) for k in kinds]
    rows = df.collect()
    return rows


def by_id(rows, texts):
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(texts)
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, texts):
    rows = by_id(run(spark, "op1_ngram_llr_rules", ["doc_id:bigint", "n_words:bigint", "word_chars:bigint", "n_symbols:bigint", "n_dup_lines:bigint", "n_repeat_words:bigint", "base_failed:boolean", "kept:boolean"]), texts)
    for i, r in rows.items():
        assert tuple(r)[1:6] == brute_base(texts[i])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_op2_finds_every_exact_passage(spark, texts):
    rows = {(r["doc_id"], r["item_id"]) for r in run(spark, "op2_cgk_decontamination", ["doc_id:bigint", "item_id:bigint"])}
    plain = lambda t: " ".join(WORD.findall((t or "").translate(LOW)))
    items = {r["item_id"]: plain(r["text"]) for r in common.table(spark, SF, "benchmark").collect()}
    assert {(i, k) for i, t in texts.items() for k, x in items.items() if f" {x} " in f" {plain(t)} "} <= rows


def test_op3(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_bpe.tokenizer_file("word_bpe_49k.json"))
    tok.encode_special_tokens = False
    rows = by_id(run(spark, "op3_ranked_token_files", ["doc_id:bigint", "start:bigint", "n_tokens:bigint", "ids_crc32:bigint"]), texts)
    start = 0
    for i in sorted(texts):
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4(spark, texts):
    rows = by_id(run(spark, "op4_minimax_shards", ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"]), texts)
    shards, of_text = collections.defaultdict(list), collections.defaultdict(set)
    for i, r in rows.items():
        data = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r["slot"])
        of_text[data].add(r["shard"])
    assert set(shards) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in shards.values()) and all(len(v) == 1 for v in of_text.values())


def test_op5(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in by_id(run(spark, "op5_byte_bpe", ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]), texts).items():
        ids = np.array(enc.encode_ordinary(texts[i] or ""), "<u4")
        assert tuple(r) == (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[i] or "").encode()).hexdigest())


def test_op7(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in common.table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = by_id(run(spark, "op7_family_svm", ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"]), texts)
    learned = {v for i, v in lang.items() if v is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    right = []
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i] or "")) and (r["lang_pred"] == "und" or r["lang_pred"] in learned)
        if r["held_out"] and lang[i] is not None and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == lang[i])
    assert sum(right) >= 0.9 * len(right)


def test_op9(spark, texts):
    rows = by_id(run(spark, "op9_cotraining", ["doc_id:bigint", "quality_score:double", "kept:boolean"]), texts)
    assert all(0 <= r["quality_score"] <= 1 and r["kept"] == (r["quality_score"] >= 0.5) for r in rows.values())


def test_op10(spark, texts):
    rows = by_id(run(spark, "op10_elias_fano_lm", ["doc_id:bigint", "held_out:boolean", "n_tokens:bigint", "n_known:bigint", "train_tokens:bigint", "base_score:double", "score:double"]), texts)
    tokens = {i: WORD.findall((t or "").translate(LOW)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for i, r in rows.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    seen = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
