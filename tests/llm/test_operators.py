"""Each operator against a brute-force version on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ctph, interleave, langid, mixing, packing, quality, simhash, toxicity, voronoi, warc
from tessera.llm.common import attach, ordered, save

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120, 400])))
        rows.append((i * 3, text, "en", f"s{rng.randint(0, 4)}", len(text)))
    rows += [(1000, rows[3][1], "en", "s0", 1), (1001, rows[3][1], "en", "hot", 1), (1001, rows[3][1], "en", "hot", 1)]
    rows += [(1002, None, None, None, None), (1003, "", "en", None, 0), (None, "a b c d", "en", "s1", 7), (1004, " \t\n", "en", "s1", 3), (1005, "Ünï cödé \x85 x", "de", "é", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_attach_joins_hot_null_and_missing_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 700 else None if i < 750 else f"k{i}") for i in range(2000)], "i long, key string")
    facts = save(rows.filter("key is not null and (key = 'hot' or i % 2 = 0)").groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("least")))
    got = {r["i"]: r["least"] for r in attach(rows, facts, "key", [F.col("i")]).collect()}
    assert got == {i: 0 if i < 700 else None if i < 750 or i % 2 else i for i in range(2000)}


def test_ordered_counts_without_gaps(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "a long, b long")
    got = ordered(rows, [F.col("a")], "at").orderBy("at").collect()
    assert [(r["at"], r["a"]) for r in got] == [(i, i) for i in range(1000)]


def test_warc_round_trip_keeps_bytes_and_resolves_revisits(spark, tmp_path):
    rng = random.Random(1)
    long = [bytes(rng.choice(b"ab\r\n\r\nWARC/1.1\x00\xff") for _ in range(rng.randint(1000, 3000))) for _ in range(30)]
    payloads = [*long, *long[:10], *long[:5], b"", None, b"\r", b"\r\n\r\n", b"x\r\r\n", b"WARC/1.1\r\n\r\n", b"short", b"short", (b"\r" * 70_000) + b"\n"]
    rows = [(i, None if i % 7 == 0 else f"http://e/{i}\r\nX: y", p) for i, p in enumerate(payloads)] + [(None, "http://null", long[20])]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "id long, url string, payload binary").repartition(3), path)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, p in rows:
        if i is not None and p is not None and len(p) >= 1000:
            last[p] = max(i, last.get(p, -1))
    for i, url, p in rows:
        r = got[f"<urn:record:{'null' if i is None else i}>"]
        body = bytes(p or b"")
        assert r["digest_ok"] and r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        if body in last and last[body] != i:
            assert (r["record_type"], r["payload"], r["refers_to_id"]) == ("revisit", None, f"<urn:record:{last[body]}>")
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == body and r["refers_to_id"] is None
        assert (r["target_uri"] is None) == (url is None)
    warc.write(spark.createDataFrame([], "id long, url string, payload binary"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_shuffles_no_bodies(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, "u", bytes([65 + i % 3]) * 2000) for i in range(40)], "id long, url string, payload binary")
    seen = []
    monkeypatch.setattr(warc, "_emit", lambda records, path, date: seen.append(records))
    warc.write(rows, str(tmp_path / "x"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "payload" in plan and not any("Exchange" in line and "Broadcast" not in line for line in plan.splitlines())


def test_warc_merge_resolves_revisits_of_archives(spark, tmp_path):
    a, b, c = (bytes([65 + i]) * 1500 for i in range(3))
    schema = "id long, url string, payload binary"
    warc.write(spark.createDataFrame([(1, "u1", a), (2, "u2", a), (3, "u3", b), (8, None, b"tiny")], schema), str(tmp_path / "x"))
    warc.write(spark.createDataFrame([(4, "u4", a), (5, "u5", c), (6, "u6", c), (9, "u9", b"tiny")], schema), str(tmp_path / "y"))
    paths = [str(tmp_path / "x"), str(tmp_path / "y")]
    found = {r["record_id"][12:-1]: r for r in warc.originals(warc.read(spark, paths, with_payload=False)).collect()}
    assert found["1"]["original_id"] == "<urn:record:4>" and found["1"]["original_uri"] == "u4" and found["4"]["original_id"] is None
    warc.merge(spark, paths, str(tmp_path / "z"))
    got = {r["record_id"][12:-1]: r for r in warc.read(spark, str(tmp_path / "z")).collect()}
    assert {k: r["record_type"] for k, r in got.items()} == {"1": "revisit", "2": "revisit", "3": "response", "4": "response", "5": "revisit", "6": "response", "8": "response", "9": "response"}
    assert {got[k]["refers_to_id"] for k in "12"} == {"<urn:record:4>"} and got["5"]["refers_to_id"] == "<urn:record:6>"
    assert all(r["digest_ok"] for r in got.values()) and bytes(got["4"]["payload"]) == a and bytes(got["9"]["payload"]) == b"tiny"
    # an archive whose response is elsewhere keeps its reference
    alone = warc.read(spark, str(tmp_path / "z")).filter("record_type = 'revisit'")
    assert warc.originals(alone).filter("original_id is not null").isEmpty()


def test_interleaving_is_even_and_proportional(spark, docs):
    got = interleave.interleave(docs, "source", 8, 5, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for source in {r["source"] for r in got}:
        counts = [sum(r["source"] == source and r["shard"] == s for r in got) for s in range(8)]
        assert max(counts) - min(counts) <= 2
    assert interleave.interleave(empty(spark), "source", 8, 5, ["doc_id"]).count() == 0
    rows = {(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] != 1001}
    by_source, n = {}, docs.count()
    for r in docs.collect():
        code = hashlib.md5(":".join(["5", *("null" if x is None else str(x) for x in (r["doc_id"], r["text"]))]).encode()).hexdigest()
        by_source.setdefault("" if r["source"] is None else "=" + r["source"], []).append((code, r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["source"]))
    line = sorted(((i + 0.5) / len(x), row[0], key, row) for key, x in by_source.items() for i, row in enumerate(sorted(x)))
    want = {}
    for place, (*_, row) in enumerate(line):
        shard = place * 8 // n
        want[(row[2] if row[1] else None, row[3], row[4])] = (shard, place - -(-shard * n // 8))
    got = {(r["doc_id"], r["text"] or "", r["source"]): (r["shard"], r["slot"]) for r in got}
    assert all(got[k] == want[k] for k in want if k[0] != 1001) and len(rows) > 100


def test_mixture_meets_targets(spark, docs):
    rows = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    got = mixing.plan(rows, "doc_id").collect()
    sizes = {}
    for r in rows.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in names if s not in free)
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        free -= above
    target = {s: level * weight[s] if s in free else 3.0 * sizes[s] for s in names}
    assert len(got) == docs.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 3
        rate = target[r["source"]] / max(1, sizes[r["source"]])
        assert int(rate) <= r["copies"] <= int(rate) + 1
    copies = {r["doc_id"]: r["copies"] for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect() if r["doc_id"] != 1001} == {d: c for d, c in copies.items() if c and d != 1001}
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_plan_keeps_every_limit(rule):
    rng = random.Random(2)
    histogram = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(40)}
    limits = packing.Limits(tokens=100, documents=6, attention=4000 + 100 * 100 // 2)
    histogram = {k: v for k, v in histogram.items() if k * k <= limits.attention}
    slots, made = packing.plan(histogram, limits, rule, packing.Weights(1, 0.5, 0.5))
    bins = {}
    for length, count in histogram.items():
        mine = slots[slots[:, 0] == length]
        for rank in range(count):
            _, first, seq, each, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            bins.setdefault(seq + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    assert set(bins) == set(range(made))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 100 and len(content) <= 6 and sum(x * x for _, x in content) <= limits.attention


def test_packing_round_trip_and_ids(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.encoder(path)
    odd = ["a<|endoftext|>b", " x\n\n  y z ​", "it's I'LL 123 ½ ٣ 日本語 🙂🙂", "", "A" * 5000, " \x85\x1c", " " * 1_000_000 + "x", "x" + "\n" * 300_000]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for text in [*odd, *texts.values()]:
        assert own(text) == library.encode(text, add_special_tokens=False).ids
    got = packing.pack(docs.withColumn("text", F.when(F.col("doc_id") == 6, F.repeat(F.lit("many words here "), 2500)).otherwise(F.col("text"))), path, with_ids=True).collect()
    texts[6] = "many words here " * 2500
    by, seqs = {}, {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        if r["doc_id"] != 1001:
            by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(texts) - {1001}
    for doc_id, rows in by.items():
        rows.sort(key=lambda r: r["piece"])
        ids = sum((list(r["ids"]) for r in rows), [])
        assert ids == [*own(texts[doc_id]), 0] and all(r["length"] == 2048 for r in rows[1:])
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
    for content in seqs.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    left = []
    for length in sorted((r["length"] for r in got), reverse=True):  # first-fit decreasing, one item at a time
        i = next((i for i, x in enumerate(left) if x >= length), None)
        if i is None:
            left.append(2048 - length)
        else:
            left[i] -= length
    assert len(seqs) <= len(left)
    assert packing.pack(empty(spark), path).count() == 0


def slow_simhash(text, k):
    out = text or ""
    words = out.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def reach(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_simhash_matches_brute_force(spark, docs):
    got = simhash.group(docs).collect()
    fps = {r["doc_id"]: r["fp"] for r in got}
    for doc_id, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        assert fps[doc_id] % (1 << 64) == slow_simhash(text, 3)
    ids = sorted({r["doc_id"] for r in got if r["doc_id"] is not None})
    close = lambda a, b: bin((fps[a] ^ fps[b]) % (1 << 64)).count("1") <= 2
    root = reach(ids, close)
    assert len(got) == docs.count() and all(r["component_id"] == root[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.group(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [2, 3])
def test_links_connect_all_close_fingerprints_in_hot_buckets(spark, bits):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(150)}
    low = [centre ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(a, 20)]  # one hot bucket of chains
    fps |= set(low) | {x ^ (1 << rng.randrange(64)) for x in list(fps)[:30]}
    nodes = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    pairs = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"), bits)
    close = lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= bits
    assert all(close(r["a"], r["b"]) for r in pairs.collect())
    root = reach(nodes, close)
    got = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    assert all(got.get(x, x) == root[x] for x in nodes)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").orderBy(F.rand(3))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_leaves_one_of_each_group(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, family = [], {}
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for j in range(1 if i else 120):  # one large family of near copies
            text = list(base)
            for _ in range(len(text) // 150 * (j > 0)):
                text[rng.randrange(len(text))] = rng.choice(words)
            family[len(rows) * 2] = i
            rows.append((len(rows) * 2, " ".join(text), "en", "s", 1))
    copies = [(10_000 + i, rows[130 + i][1], "en", "s", 1) for i in range(20)] + [rows[140], rows[140]]
    blank = [(20_000, None, None, None, None), (20_001, "", "en", "s", 0), (None, "  ", "en", "s", 2)]
    frame = spark.createDataFrame(rows + copies + blank, DOCS).withColumn("node", F.lit("clash")).withColumn("h1", F.lit(1))
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == sorted([min(d for d, f in family.items() if f == i) for i in range(150)] + [20_000])
    assert simhash.keep_one(empty(spark)).count() == 0


def edited(rng, base, words, least, most):
    """A copy of the words whose similarity to them lies in [least, most)."""
    while True:
        text = list(base)
        for _ in range(int(len(text) * (1 - least) / 10)):
            text[rng.randrange(len(text))] = rng.choice(words)
        while jaccard(" ".join(base), " ".join(text)) >= most:
            text[rng.randrange(len(text))] = rng.choice(words)
        if jaccard(" ".join(base), " ".join(text)) >= least:
            return text


def test_keep_one_decides_by_exact_similarity(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, want = [], set()
    for i in range(240):  # pairs from 0.66 to 0.90, each of words of its own
        base = [f"{rng.choice(words)}{i}" for _ in range(rng.randint(120, 400))]
        low = 0.66 + i % 12 * 0.02
        texts = [" ".join(x) for x in (base, edited(rng, base, words, low, low + 0.02))]
        rows += [(2 * i + j, text, "en", "s", 1) for j, text in enumerate(texts)]
        want |= {2 * i} if jaccard(*texts) >= 0.8 else {2 * i, 2 * i + 1}
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"] for r in got.collect()} == want


def test_keep_one_joins_copies_through_their_original(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6):  # the copies come before their original but for one, which is like that alone
        base = [f"w{i}x{rng.randrange(10**9)}" for _ in range(300)]
        spots = [range(at, 300, 60) for at in range(5, 55, 3)]
        texts = [" ".join(f"{w}y{j}" if at in edits else w for at, w in enumerate(base)) for j, edits in enumerate(spots)]
        texts.insert(-1, " ".join(base))
        assert all(jaccard(t, texts[-2]) >= 0.8 for t in texts) and all(jaccard(t, texts[-1]) < 0.8 for t in texts[:-2])
        rows += [(100 * i + j, text, "en", "s", 1) for j, text in enumerate(texts)]
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"] for r in got.collect()} == {100 * i for i in range(6)}


def near_copies(seed, count):
    """Rows of ``count`` texts, each with a copy of similarity 0.8 to 0.96 behind it, and one family of 60 near copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        base = [f"w{i}x{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(len(rows) + j, " ".join(x), "en", "s", 1) for j, x in enumerate((base, edited(rng, base, ["other"], 0.8, 0.96)))]
    base = [f"v{rng.randrange(10**9)}" for _ in range(300)]
    return rows + [(len(rows) + j, " ".join([*base[:j], f"y{j}", *base[j + 1 :]]), "en", "s", 1) for j in range(60)]


def test_near_duplicates_come_from_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rows = near_copies(5, 20)
    frame = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.unique(spark, frame, "").collect()} == {*range(0, 40, 2), 40}
    monkeypatch.setattr(simhash, "blocks", lambda *_: np.full((1, simhash.WORDS), -1, np.int64))  # only equal fingerprints meet
    assert {*range(40)} <= {r["doc_id"] for r in corpus_pipeline.unique(spark, frame, "").collect()}


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    rows = near_copies(6, 20)
    monkeypatch.setattr(simhash, "SPLIT", 8)
    monkeypatch.setattr(simhash, "blocks", lambda *_: np.zeros((1, simhash.WORDS), np.int64))  # one bucket, in 13 parts
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"] for r in got.collect()} == {*range(0, 40, 2), 40}


@pytest.mark.parametrize("count", [1_000, 200_000, 12_000_000])
def test_fingerprints_make_candidates_of_similar_sets(count):
    rng = np.random.default_rng(4)
    masks, met = simhash.blocks(0.8, count).view(np.uint64), 0
    for i in range(900):
        size, similarity = (20, 60, 400)[i % 3], (0.8, 0.85, 0.9)[i // 3 % 3]
        both = -int(-2 * size * similarity // (1 + similarity))
        x = rng.integers(0, 1 << 64, 2 * size - both, np.uint64)
        fps = np.stack([simhash.majority(x[:size], simhash.WORDS), simhash.majority(np.concatenate([x[:both], x[size:]]), simhash.WORDS)])
        agree = ((fps.view(np.uint64)[0] ^ fps.view(np.uint64)[1]) & masks == 0).all(1).any()
        met += bool(agree and sum(len(a) for a, *_ in simhash.close_rows(fps, np.array([size, size]), np.array([0, 1]), 0.8, False)))
    assert met >= 0.995 * 900


def test_edit_distance_matches_the_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert ctph.distance(a, b) == row[-1]


def test_piecewise_hashes_follow_the_order(spark, docs):
    rows = [r for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    got = {r["doc_id"]: r for r in ctph.edits(docs).collect()}
    assert len(got) == len({r["doc_id"] for r in rows}) and ctph.edits(docs).count() == len(rows)
    for i, r in enumerate(order):
        if r["doc_id"] == 1001:
            continue
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["fingerprint"] == ctph.fingerprint(text.encode()) and g["edited_fingerprint"] == ctph.fingerprint(edited.encode())
        assert g["near_next"] == ctph.likeness(g["fingerprint"], ctph.fingerprint(after.encode()))
    one = ctph.edits(spark.createDataFrame([(7, "only one text here", "en", "s", 1)], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert ctph.edits(empty(spark)).count() == 0


def test_piecewise_likeness_separates(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(50, 900))) for _ in range(60)]
    prints = [ctph.fingerprint(t.encode()) for t in texts]
    edited = [ctph.fingerprint((t[: len(t) - len(t) // 3] + texts[i - 1][: len(t) // 3]).encode()) for i, t in enumerate(texts)]
    assert min(ctph.likeness(a, b) for a, b in zip(prints, edited, strict=True)) > 0.3
    assert max(ctph.likeness(prints[i], prints[i - 1]) for i in range(60)) < 0.2


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(400)]
    vectors += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2200, []), (2250, [1.0, 2.0]), (301, vectors[5][1]), (301, vectors[5][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = voronoi.top_k(save(voronoi.quantized(frame)), F.col("vec_id") % 50 == 0).collect()
    fine = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    big = [(50, [2.0**22, 1.0, -(2.0**22)]), (1, [2.0**20, 3.0, 5.0]), (2, [2.0**20, 2.0, 5.0]), (3, [2.0**20, 2.0, 5.0 - 2**-8])]
    base = save(voronoi.quantized(spark.createDataFrame(big, "vec_id long, embedding array<double>")))
    exact = sorted((-sum(int(x * 256) * int(y * 256) for x, y in zip(big[0][1], v, strict=True)), i) for i, v in big[1:])
    assert [(-r["score"], r["vec_id"]) for r in voronoi.top_k(base, F.col("vec_id") == 50).orderBy("rank").collect()] == exact
    with pytest.raises(Exception, match="too large"):
        voronoi.quantized(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()
    none = save(voronoi.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert voronoi.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("together", [4, 1000])
def test_top_k_prunes_rows_that_no_group_needs(spark, monkeypatch, together):
    """Far clusters, and ids that repeat: bounds bite, and no neighbour may be lost."""
    monkeypatch.setattr(voronoi, "TOGETHER", together)
    monkeypatch.setattr(voronoi, "BLOCK", 100)
    rng = np.random.default_rng(4)
    centres = np.eye(6) * 40
    vectors = [(int(i % 150), (centres[i % 6] + rng.normal(size=6) / 4).tolist()) for i in range(600)]
    sent = []
    plain = voronoi.map_arrow
    monkeypatch.setattr(voronoi, "map_arrow", lambda df, f, schema: sent.append(save(plain(df, f, schema))) or sent[-1])
    got = voronoi.top_k(save(voronoi.quantized(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))), F.col("vec_id") % 50 == 0).collect()
    assert sent[-1].agg(F.sum(F.size("needed_by"))).first()[0] < 600 * 6
    fine = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in vectors]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def levenshtein(a, b):
    return ctph.distance(a, b)


def test_automaton_meets_what_brute_force_meets():
    rng = random.Random(8)
    terms = ["idiot", "scum", "pathetic", "lowei*", "vequ*", "abc"]
    automaton = toxicity.Automaton(terms)
    words = {"idiot", "1diot", "idiots", "scm", "pathtic", "pathxxtic", "loweichen", "lweixyz", "abc", "ab", "", "x"}
    words |= {"".join(rng.choice("idotscumphelwvq") for _ in range(rng.randint(1, 10))) for _ in range(2000)}
    for word in words:
        best = None
        for i, term in enumerate(terms):
            stem = term.removesuffix("*")
            ways = [word[:j] for j in range(len(word) + 1)] if term.endswith("*") else [word]
            e = min(levenshtein(stem, w) for w in ways)
            if e <= toxicity.allowed(len(stem)) and (best is None or (e, i) < best):
                best = (e, i)
        got = automaton.match(word)
        assert (got and (got[1], got[0])) == best, word


def toxic_tables(spark, n=600):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(60)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_terms_and_spares_quotations(spark):
    rows, labels = toxic_tables(spark)
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs.filter("doc_id % 4 <> 2"), labels.filter("doc_id % 4 <> 2"))
    assert {"idiot", "moron"} <= set(model.terms)
    extra = [(9000, "you are an idiiot my friend", "en", "s", 1), (9001, 'she said "the word idiot is rude" today', "en", "s", 1), (9002, None, "en", "s", 1), (9003, "", "en", "s", 1)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([*rows, *extra], DOCS), model).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert all((scores[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert scores[9000] >= 0.3 > scores[9002] == scores[9003] and scores[9001] < scores[9000]
    blank = toxicity.train(docs, labels.filter("toxic = 9"))
    assert {round(r["score"], 6) for r in toxicity.score(docs, blank).collect()} == {round(1 / (1 + np.exp(2.0)), 6)}


def test_prior_and_risk_find_the_negatives():
    rng = np.random.default_rng(2)
    positive = rng.normal(1, 1, (2000, 6))
    unlabelled = np.concatenate([rng.normal(1, 1, (2100, 6)), rng.normal(-1.5, 1, (900, 6))])
    model = quality.fit(positive, unlabelled)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.scores(rng.normal(1, 1, (500, 6))) >= 0.3).mean() > 0.97 and (model.scores(rng.normal(-1.5, 1, (500, 6))) < 0.3).mean() > 0.9


def test_quality_scores_whole_table(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clash = docs.withColumn("quality_score", F.lit("mine"))
    model = quality.train(clash, quality.trusted(none, "quality", F.lit(True)))
    scored = quality.score(clash, model)
    assert scored.count() == docs.count() and scored.columns == [*clash.columns, "_quality_score"]
    assert {r["_quality_score"] for r in scored.collect()} == {0.5} and quality.score(empty(spark), model).count() == 0
    assert quality.score(docs, model, keep_from=0.3).columns == docs.columns
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert [r[0] for r in quality.trusted(mixed, "quality", F.lit(True)).collect()] == [2]
    all_labelled = docs.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"))
    assert quality.score(docs, quality.train(docs, quality.trusted(all_labelled, "quality", F.lit(True)))).count() == docs.count()
    long = spark.createDataFrame([(1, "word " * 400_000, "en", "s", 1), (1, "word " * 400_000, "en", "s", 1)], DOCS)
    assert len({r["quality_score"] for r in quality.score(long, model).collect()}) == 1


def test_language_from_text_and_from_other_evidence(spark):
    rng = random.Random(11)
    letters = {"en": "thewandofris", "de": "schungeidrpf"}
    text = lambda code, n=40: " ".join("".join(rng.choice(letters[code]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, text(c), "de" if i % 40 == 0 else c, f"www.{c}{i % 3}.{c}", f"{c}{i % 3}.{c}", c) for i, c in enumerate(["en", "de"] * 200)]
    rows += [(9000, "12 34", None, "www.de0.de", "de0.de", "de"), (9001, None, "en-US", None, None, None), (9002, text("de"), "en", None, None, None), (9002, text("de"), "en", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = langid.identify(frame.withColumn("declared", langid.declared_code(F.col("declared")))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["language"] == c and by[i]["accepted"] for i, c in enumerate(["en", "de"] * 200))
    assert by[9000]["language"] == "de" and not by[9000]["accepted"]  # only its host and suffix speak
    assert by[9001]["language"] == "en" and not by[9001]["accepted"]
    assert by[9002]["language"] == "de" and by[9002]["accepted"]
    assert langid.identify(frame.limit(0)).count() == 0


def test_rare_languages_are_one_class_and_none_gives_unknown(spark):
    rng = random.Random(3)
    letters = {"en": "thewandofris", "de": "schungeidrpf", **{c: "zkqvxyjw" for c in ("cs", "pl", "sk")}}
    text = lambda code: " ".join("".join(rng.choice(letters[code]) for _ in range(rng.randint(2, 8))) for _ in range(40))
    rows = [(text(c), c) for c in ["en", "de"] * 60 + ["cs", "pl", "sk"] * 4]
    frame = spark.createDataFrame(rows, "text string, declared string").withColumns({c: F.lit(None).cast("string") for c in ("host", "domain", "suffix")})
    got = langid.identify(frame.withColumn("code", F.col("declared"))).collect()
    assert all(r["language"] == (r["code"] if r["code"] in ("en", "de") else "other") and r["accepted"] for r in got)
    got = langid.identify(frame.withColumn("declared", F.lit(None).cast("string"))).select("language").distinct().collect()
    assert [r[0] for r in got] == ["und"]


def slow_fuse(rows, n, g_of):
    """Posteriors by plain sums over all other rows."""
    k = langid.KAPPA
    for r in rows:
        e = np.exp(np.array(r["ll"]) - max(r["ll"]))
        p = e / e.sum()
        r["p"] = np.where(p >= langid.VOTE, p, 0.0) if r["trigrams"] else np.zeros(n)
        r["w"] = float(r["trigrams"] > 0)
    g = (sum(r["p"] for r in rows) + 1) / (sum(r["w"] for r in rows) + n)
    out = []
    for r in rows:
        def share(parent, same):
            if same is None:
                return (k * parent) / k, 0.0
            rest = [x for x in rows if x is not r and same(x)]
            w = sum(x["w"] for x in rest)
            return (sum((x["p"] for x in rest), np.zeros(n)) + k * parent) / (w + k), w

        domain, _ = share(g, (lambda x: x["domain"] == r["domain"]) if r["domain"] else None)
        host, w = share(domain, (lambda x: (x["host"], x["domain"], x["suffix"]) == (r["host"], r["domain"], r["suffix"])) if r["host"] else None)
        said, _ = share(g, (lambda x: x["declared"] == r["declared"]) if r["declared"] else None)
        suffix, _ = share(g, (lambda x: x["suffix"] == r["suffix"]) if r["suffix"] else None)
        f = np.array(r["ll"]) + np.log(host) + np.log(said / g) + np.log(suffix / g) * k / (w + k)
        e = np.exp(f - f.max())
        out.append((int(f.argmax()), float(e.max() / e.sum())))
    return out


def test_fusion_matches_plain_sums(spark):
    rng = random.Random(17)
    rows = []
    for i in range(200):
        host, domain, suffix = rng.choice([(None, None, None), ("a.x.de", "x.de", "de"), ("b.x.de", "x.de", "de"), ("y.fr", None, "fr"), ("z", None, None)])
        rows.append({"id": i, "declared": rng.choice([None, "de", "en", "fr"]), "host": host, "domain": domain, "suffix": suffix, "trigrams": rng.choice([0, 5, 900]), "ll": [rng.uniform(-9, 0) for _ in range(3)]})
        if not rows[-1]["trigrams"]:
            rows[-1]["ll"] = [0.0] * 3
    schema = "id long, declared string, host string, domain string, suffix string, trigrams long, ll array<double>"
    frame = save(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    model = langid.Model(["de", "en", "fr"], [])
    got = {r["id"]: r for r in langid.fuse(frame, model).collect()}
    for r, (best, confidence) in zip(rows, slow_fuse([dict(r) for r in rows], 3, None), strict=True):
        assert got[r["id"]]["language"] == model.languages[best] and got[r["id"]]["confidence"] == pytest.approx(confidence, rel=1e-9)


def test_accepted_keeps_rows_and_columns(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("the and of with", "und der die nicht")[i % 2].split()) for _ in range(60)), ("en", "de")[i % 2], "s", 1) for i in range(80)]
    rows += [(900, None, "en", "s", 1), (901, "", "en", None, 1), (902, "12 34", "de", "s", 1), (903, "the and of " * 200_000, "en", "s", 1), rows[3]]
    frame = spark.createDataFrame(rows, DOCS).withColumn("h1", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("declared", F.lit(2))
    got = langid.accepted(frame)
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == sorted([*range(80), 3, 903])
    assert langid.accepted(frame.limit(0)).count() == 0


def test_addresses_and_markup(spark):
    urls = {"https://example.com/x": ("example.com", None, "com"), "http://a.b.shop.co.uk": ("a.b.shop.co.uk", "shop.co.uk", "uk"), "http://1.2.3.4/": ("1.2.3.4", None, None), "http://www.xn--e1a.xn--p1ai/": ("www.xn--e1a.xn--p1ai", "xn--e1a.xn--p1ai", "xn--p1ai"), "/relative": (None, None, None)}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: tuple(r[1:]) for r in rows.select("url", *[c.alias(str(i)) for i, c in enumerate(langid.address(F.col("url")))]).collect()} == urls
    row = spark.createDataFrame([("https://u:p@Www.Example.co.de:80/en/x?y#z", '<HTML class=a lang="de-AT"><script>no()</script><!-- no --><p>ja</p>')], "url string, html string")
    host, domain, suffix = langid.address(F.col("url"))
    text, declared = langid.markup(F.col("html"))
    assert tuple(row.select(host, domain, suffix, F.trim(text), declared).first()) == ("www.example.co.de", "example.co.de", "de", "ja", "de")
