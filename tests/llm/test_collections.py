"""Operators over whole collections against brute force: near duplicates, decontamination, shards, archives, pipeline."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthcal.llm import byte_bpe, common, decontaminate, near_dedup, quality_classifier, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(base, seed, edits):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(x & y)
        if x and y and 100 * both >= percent * (len(x) + len(y) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, docs, percent):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Two words"), (4, "two WORDS"), (5, "two words more"), (None, "two words"), (None, None)]
    n = 10
    for g in range(12):  # groups of edited copies of one base, near the threshold on both sides
        base = words(g, 150)
        for k in range(12):
            rows.append((n, edited(base, n, k // 2)))
            n += 1
    rows += [(n + k, edited(words(77, 120), 5, 0)) for k in range(40)]  # one large group of copies
    rows += [(n + 100 + k, edited(words(78, 150), 900 + k, 4)) for k in range(40)]  # and of near copies
    rows += [(3, "two words"), (rows[9][0], " ".join(words(3, 150)))]  # ids that two rows share
    random.Random(1).shuffle(rows)
    df = docs(rows).withColumn("component_id", F.lit("clash")).withColumn("kept", F.lit(2))
    got = near_dedup.near_duplicates(df, percent).collect()
    want = brute_components(rows, percent)
    assert len(got) == len(rows)
    sizes = collections.Counter((r["doc_id"], r["n_shingles"]) for r in got)
    assert sizes == collections.Counter((i, len(shingles(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    one = near_dedup.drop_near_duplicates(df, percent)
    assert one.columns == df.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values()}) and ids.count(None) == 2


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    assert near_dedup.near_duplicates(docs([None, ""])).where("kept").count() == 2


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[300:2300])
    ra, rb, rc = near_dedup.sketch([a, b, np.union1d(a, b)])
    assert np.array_equal(np.maximum(ra, rb), rc)
    j = near_dedup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1700 / 2300) < 0.14


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_decontamination_matches_brute_force(spark, docs):
    items = {k: words(1000 + k, 10 + 3 * k) for k in range(14)} | {50: ["short", "item"], 51: []}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(60, None)], "item_id long, text string")
    texts = [None, "", "short ITEM", "a short\titem b", "short b item"]
    rng = random.Random(3)
    for k in range(14):
        for edits in (0, 1, 2, 6):
            body = edited(items[k], 10 * k + edits, edits).split()
            texts.append(" ".join([*words(rng.randrange(10**6), 70), *body, *words(rng.randrange(10**6), 50)]))
    df = docs(texts).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        for k, item in items.items():
            limit = int(0.1 * len(item) + 1e-9)
            near = [edit_distance(item, w[p:p + n]) for p in range(len(w)) for n in range(max(1, len(item) - limit), len(item) + limit + 1) if p + n <= len(w)] if item and 2 * len(set(item) & set(w)) >= len(set(item)) else []
            if near and min(near) <= limit:
                want[i, k] = min(near)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[p]["edit_distance"] == want[p] for p in got) and {p for p, d in want.items() if d == 0} <= set(got)
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert decontaminate.find_leaks(docs([]), bench).count() == 0
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    items = [(k, " ".join(words(k, 20))) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([t for _, t in items] + ["nothing here"])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == {(k, k) for k in range(10)}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()] == [10]


def test_long_items_are_found_beside_many_short_ones():
    rng = random.Random(8)
    new = lambda n: [rng.randrange(1 << 62) for _ in range(n)]
    items = [new(10) for _ in range(3000)] + [new(100) for _ in range(150)]
    bench = decontaminate.Benchmark(list(range(len(items))), [np.array(w, np.uint64) for w in items])
    missed = 0
    for k in range(3000, 3150):
        c = list(items[k])
        for e in range(10):
            at = rng.randrange(len(c))
            c[at:at + (e % 3 != 1)] = [] if e % 3 == 2 else new(1)
        text = np.array(new(30) + c + new(30), np.uint64)
        missed += (0, k) not in {hit[:2] for hit in bench.search(text, np.array([len(text)]))}
    assert missed <= 0.03 * 150


def test_shards_are_written_in_order(spark, docs, tmp_path):
    df = docs([f"text {k}" for k in range(50)])
    assigned = sharding.shard_documents(df, 3, 16)
    sharding.write_shards(df, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in assigned.collect()}


def greedy(sizes, capacity):
    n, fill = 1, 0
    for s in sizes:
        n, fill = (n, fill + s) if fill + s <= capacity else (n + 1, s)
    return n


def test_cuts_are_minimax(spark):
    rng = random.Random(0)
    for k, sizes in ((3, [5, 1, 1, 1, 5, 1, 1, 1]), (4, [rng.randrange(1, 50) for _ in range(60)]), (5, [1000, 3, 4, 5, 6, 7]), (6, [2, 2])):
        df = spark.createDataFrame(list(enumerate(sizes)), "grp int, size long")
        shard = {r["grp"]: r["shard"] for r in sharding.minimax_cuts(df, k).collect()}
        assert set(shard) == set(range(len(sizes))) and max(shard.values()) < k
        rest, left, heavy = sum(sizes), k, []
        for s, g in sorted(((s, -g) for g, s in enumerate(sizes)), reverse=True)[: k - 1]:
            if s * left <= rest:
                break
            heavy.append(-g)
            rest, left = rest - s, left - 1
        light = [s for g, s in enumerate(sizes) if g not in heavy]
        best = next(c for c in itertools.count(max(light, default=0)) if greedy(light, c) <= left)
        load = collections.Counter()
        for g, s in enumerate(sizes):
            load[shard[g]] += s
        assert max((load[shard[g]] for g in range(len(sizes)) if g not in heavy), default=0) <= best
        assert all(load[shard[g]] == sizes[g] for g in heavy)


def test_shards_hold_everything_once(spark, docs):
    texts = [None, "", "same"] + ["same"] * 30 + [f"text {k} " * (k % 7) for k in range(200)]
    rows = [*enumerate(texts), (3, "same"), (None, "no id")]
    df = docs(rows).withColumn("slot", F.lit("clash")).repartition(5)
    got = sharding.shard_documents(df, 6).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(6)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same")}) == 1
    assert sharding.shard_documents(docs([])).count() == 0


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", "<p>xé</p>"), (2, None, None), (3, "u", ""), (7, "http://b", "<p>xé</p>"), (5, "c\r\nd", "y\r\n\r\nz" * 1000), (9, "e", "\U0001f389"), (9, "f", "\U0001f389"), (None, "g", "y")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    paths = warc.write_warc(df)
    got = warc.read_warc(spark, paths).collect()
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    found = collections.defaultdict(list)
    for r in got:
        found[r["page_id"]].append(r)
    leaders = {}
    for i, _, h in rows:
        if i is not None:
            leaders[h or ""] = max(leaders.get(h or "", i), i)
    for i, _, h in rows:
        own = [r for r in found[i] if r["payload_digest"] == digest(h)]
        assert own and all(r["payload_length"] == len((h or "").encode()) for r in own)
        if i == 9:
            assert sorted(r["record_type"] for r in own) == ["response", "revisit"]
        elif i is None or leaders[h or ""] == i:
            assert own[0]["record_type"] == "response" and own[0]["refers_to_page_id"] is None and own[0]["payload"].decode() == (h or "")
        else:
            assert own[0]["record_type"] == "revisit" and own[0]["refers_to_page_id"] == leaders[h or ""]
    pushed = warc.read_warc(spark, paths).where("record_type = 'revisit' and payload_digest = '" + digest("<p>xé</p>") + "'")
    assert [r["page_id"] for r in pushed.collect()] == [1]
    assert all(r["payload"] is None for r in warc.read_warc(spark, paths, payload=False).collect())
    assert warc.write_warc(spark.createDataFrame([], PAGES)) == []


def test_each_payload_of_a_repeated_page_is_written(spark):
    rows = [(9, "a", "one"), (9, "b", "two"), (9, "c", "two"), (9, "d", "three"), (4, "e", "two"), (3, "f", "one"), (8, "g", "three"), (2, "h", "alone")]
    got = warc.read_warc(spark, warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3))).collect()
    assert len(got) == len(rows) == len({r["record_id"] for r in got})
    held = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    assert sorted(r["payload"].decode() for r in held.values()) == ["alone", "one", "three", "two"]
    for r in got:
        if r["record_type"] == "revisit":
            leader = held[r["refers_to"]]
            assert (leader["payload_digest"], leader["page_id"]) == (r["payload_digest"], r["refers_to_page_id"])
    payload = {r["payload_digest"]: r["payload"].decode() for r in held.values()}
    assert collections.Counter((r["page_id"], payload[r["payload_digest"]]) for r in got) == collections.Counter((i, h) for i, _, h in rows)


def test_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader(type("S", (), {"fields": []})(), {"paths": "a\nb"})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("page_id",), 1)]))
    assert len(rest) == 1 and len(reader.tests) == 2 and len(reader.partitions()) == 2


def test_payloads_stay_packed_behind_filters(spark, monkeypatch, tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.record("response", "a", {"X-Page-Id": "1", "WARC-Payload-Digest": "sha1:" + warc.digest_of(b"p")}, b"p") + warc.record("revisit", "b", {"X-Page-Id": "2"}, b""))
    reader = warc.WarcReader(type("S", (), {"fields": [type("F", (), {"name": "page_id"})]})(), {"paths": str(path)})
    list(reader.pushFilters([__import__("pyspark.sql.datasource", fromlist=["EqualTo"]).EqualTo(("record_type",), "response")]))
    unpacked = []
    monkeypatch.setattr(warc, "payload_of", lambda data, n: unpacked.append(n) or b"p")
    assert list(reader.read(reader.partitions()[0])) == [(1,)] and unpacked == [1]


@pytest.mark.parametrize("packed", ["plain", "members", "whole"])
def test_archives_of_other_writers(spark, tmp_path, packed):
    big = b"x" * 300_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    parts = []
    for k, (kind, content, more) in enumerate((("warcinfo", b"software: any\r\n", ""), ("response", http, "Content-Type: application/http; msgtype=response\r\n"), ("resource", big, ""), ("metadata", b"", ""))):
        parts.append(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\n{more}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n")
    path = tmp_path / "x.warc"
    path.write_bytes({"plain": lambda: b"".join(parts), "members": lambda: b"".join(map(gzip.compress, parts)), "whole": lambda: gzip.compress(b"".join(parts))}[packed]())
    got = {r["record_type"]: r["payload"] for r in warc.read_warc(spark, [str(path)]).collect()}
    assert {k: bytes(v) for k, v in got.items()} == {"warcinfo": b"software: any\r\n", "response": b"<p>body</p>", "resource": big, "metadata": b""}
    skipped = warc.read_warc(spark, [str(path)], payload=False).where("record_type = 'metadata'").collect()
    assert [r["record_id"] for r in skipped] == ["<urn:uuid:3>"] and skipped[0]["payload"] is None


def test_pipeline_equals_its_parts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    documents = common.table(spark, sf, "documents")
    assert [len(x) for x in pipeline.STAGES] == [2] * 5
    kept = documents
    for name, stage in pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, kept, sf), f"test-{name}")
        assert out.columns == documents.columns and out.count() <= kept.count()
        kept = out
    rows = kept.collect()
    assert 0.5 * documents.count() < len(rows)
    alone = brute_components([(r["doc_id"], r["text"]) for r in rows], 80)
    assert all(i == c for i, c in alone.items())
    bench = [" ".join(WORD.findall(r["text"].translate(LOW))) for r in common.table(spark, sf, "benchmark").collect()]
    assert not any(f" {b} " in f" {' '.join(WORD.findall(r['text'].translate(LOW)))} " for r in rows for b in bench)
    out = {r["doc_id"]: r for r in pipeline.run(spark, sf).collect()}
    assert set(out) == {r["doc_id"] for r in rows}
    assert all(out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in rows)


def test_pipeline_stages_take_odd_documents(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd = docs([None, "", "x " * 40, " ".join(words(1, 50)), (3, "again " * 3), (None, " ".join(words(2, 60)))]).withColumn("kept", F.lit(1)).withColumn("ids", F.lit("clash"))
    for table in (odd, odd.where("false")):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, table, "/root/testdata/sf0.001").columns == table.columns
            stage(spark, table, "/root/testdata/sf0.001").collect()
        pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").collect()


def test_driver_gives_memory_back(spark, docs, monkeypatch):
    """The Java runtime trims its native memory with each intermediate table, and its heap where plans or rows were large."""
    assert "rim native heap" in common.relieve(spark) and "rim native heap" in common.relieve(spark, garbage=True)
    calls, real = [], common.relieve
    for module in (common, byte_bpe, quality_classifier):
        monkeypatch.setattr(module, "relieve", lambda spark, garbage=False: calls.append(garbage) or real(spark, garbage))
    rows = docs([" ".join(words(1, 50))])
    assert common.materialize(rows, "given-back").count() == 1 and calls == [False]
    byte_bpe.production().encode(rows)
    assert calls[1:] == [True]
    quality_classifier.fit_quality(rows, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert calls[2:] == [True, True]


def test_walks_of_all_places_equal_single_ones():
    """Groups are joined ever more rarely and numbered where they are asked for; the emitted words are those of single walks."""
    words = np.random.default_rng(5).integers(0, 40, 600).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    steps = [0, 1, 7, 8, 9, 40, 63, 64, 65, 130]
    n = len(words)
    want = decontaminate.embed(words, 1, np.arange(n), np.full(n, n - 1), steps)
    found = decontaminate.embed_all(words, 1, steps, {8, 40, 130})
    for step, emitted, (first, word, group) in zip(steps, want, found, strict=True):
        assert (np.repeat(word, np.diff(np.append(first, n))) == emitted).all()
        assert (group is None) == (step not in {8, 40, 130})
        assert group is None or (word[group] == emitted).all()


def test_stages_give_memory_back_and_read_texts_once(spark, docs, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == [1]
    df = docs(["a b", None])
    assert common.text_column(df) == df.columns.index("text")
    assert common.text_column(df.select("doc_id", df.text.cast("binary").alias("text"))) is None
    bench = spark.createDataFrame([(1, "p q r s t u v w x y z a b")], "item_id long, text string")
    rows = docs(["k l " + "p q r s t u v w x y z a b" + " m", "clean words", None])
    kept = decontaminate.drop_leaks(rows, bench)
    assert "__text" not in kept._jdf.queryExecution().toString()  # whole texts went to a worker twice
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and kept.columns == rows.columns
    as_bytes = rows.withColumn("text", rows.text.cast("binary"))
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(as_bytes, bench).collect()) == [1, 2]
