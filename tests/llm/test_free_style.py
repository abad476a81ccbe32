"""Operators without SQL, against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import decontaminate, importance, lm_scoring, packing, queries, simhash, token_counts

ODD = [
    (1, "The cat sat on the mat. The cat sat on the mat.", 1), (2, None, 2), (3, "", 3), (4, "  \t\n ", 4), (5, "one", 5),
    (6, "a<|endoftext|>b it's DON'T 12³ naïve", 6), (7, "İstanbul ΣΑΣ x́y 中文 😀\x85\x1c", 7), (8, "the cat sat on the mat. the cat sat on the mat.", 8),
    (9, "word " * 9000, 9), (9, "word " * 9000, 9), (None, "no id at all", 10), (None, None, 11), (12, "two words", 12),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, sequence_id long").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def check_packing(rows, texts, least_full):
    encode = library()
    wanted = Counter()
    for doc_id, text in texts:
        wanted[doc_id, tuple(encode.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, ids), times in wanted.items():
        own = [r for r in by_doc[doc_id] if r["doc_tokens"] == len(ids)]
        got = Counter((r["start"], r["length"], r["ids_crc32"]) for r in own)
        at = 0
        while at < len(ids):
            (start, length, crc), n = next((k, n) for k, n in got.items() if k[0] == at and k[2] == zlib.crc32(np.array(ids[at : at + k[1]], "<u4").tobytes()))
            assert n >= times
            at += length
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in wanted.items())
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows) >= least_full * 4096 * len(windows)


def test_packing(spark, sf, docs, odd):
    check_packing(queries.op1_packing(spark, sf).collect(), docs, 0.97)
    check_packing(packing.pack(odd, queries.vocabulary()).collect(), [r[:2] for r in ODD], 0.5)
    assert packing.pack(odd.limit(0), queries.vocabulary()).count() == 0
    assert packing.pack(odd.filter("doc_id = 6"), queries.vocabulary(), with_ids=True).first()["ids"][-1] == 2


def test_difference_is_balanced():
    sizes = np.random.default_rng(1).integers(1, 512, 4000)
    sums = np.bincount(packing.difference(sizes, 250), sizes)
    assert len(sums) == 250 and sums.max() - sums.min() < 0.01 * sums.mean()


def test_token_counts(spark, sf, docs, odd):
    encode = library()
    for rows, texts in ((queries.op3_token_counts(spark, sf).collect(), docs), (token_counts.count_tokens(odd, queries.vocabulary()).collect(), [r[:2] for r in ODD])):
        want = Counter((i, len((t or "").encode()), n := len(encode.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert token_counts.count_tokens(odd.limit(0), queries.vocabulary()).count() == 0


def test_merges_equal_the_library():
    table, encode = token_counts.MergeTable(queries.vocabulary()), library()
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("aaaabeinorst", k=rng.randint(1, 30))) for _ in range(4000)} | {"a" * n for n in range(1, 60)})
    assert table.counts(words).tolist() == [len(x.ids) for x in encode.encode_batch(words, add_special_tokens=False)]


def test_long_pre_tokens():
    import time

    table, encode = token_counts.MergeTable(queries.vocabulary()), library()
    rng = random.Random(4)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "aaab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz") for n in (256, 300, 5000)] + ["a" * 1001, "ab" * 700]
    want = [len(x.ids) for x in encode.encode_batch(words, add_special_tokens=False)]
    assert table.counts(words).tolist() == table.linked([w.encode() for w in words]).tolist() == want
    assert table.ragged([w.encode() for w in words[:6]]).tolist() == want[:6]
    start = time.time()
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert table.counts([word])[0] > 200_000 and time.time() - start < 30


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(queries.vocabulary(), encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    with pytest.raises(ValueError, match="no byte-level BPE"):
        token_counts.MergeTable(str(path))


def brute_simhash(texts, radius=2):
    from xxhash import xxh64_intdigest

    prints = []
    for _, text in texts:
        words = WORD.findall(low(text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, (doc_id, _) in enumerate(texts))


def test_simhash(spark, sf, docs, odd, monkeypatch):
    got = lambda df: Counter(map(tuple, df.collect()))
    want = brute_simhash(docs)
    assert got(queries.op7_simhash(spark, sf)) == want
    assert got(simhash.near_duplicates(odd)) == brute_simhash([r[:2] for r in ODD])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({c for _, _, c in want})
    assert simhash.keep_one(odd).filter("doc_id = 9").count() == 1
    monkeypatch.setattr(simhash, "BUCKET", 1)  # every bucket is divided again
    assert got(queries.op7_simhash(spark, sf)) == want


def brute_hits(text, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found, places = word.findall(low(text)), set(), set(), {}
    for item, item_text in items:
        own = word.findall(low(item_text))
        n = min(size, len(own))
        if n and n not in places:
            places[n] = defaultdict(list)
            for i in range(len(words) - n + 1):
                places[n][tuple(words[i : i + n])].append(i)
        for i in range(len(own) - n + 1 if n else 0):
            for at in places[n].get(tuple(own[i : i + n]), ()):
                hit |= set(range(at, at + n))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choices("alpha beta gamma Delta épsilon".split(), k=n))
    items = [(i, make(rng.choice((0, 1, 4, 13, 20)))) for i in range(12)] + [(3, make(15)), (None, make(14)), (50, None)]
    texts = [(i, make(rng.randint(0, 60)) + rng.choice(["", " - "]) + (rng.choice(items)[1] or "").upper() + "... " + make(40)) for i in range(60)] + [(61, None), (62, "")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = {i: brute_hits(t, items) for i, t in texts}
    for block in (10**6, 20):
        rows = decontaminate.contamination(docs, bench, block_words=block).collect()
        assert {r["doc_id"]: tuple(r)[2:] for r in rows} == want
    assert decontaminate.contamination(docs, bench, remove="documents").count() == sum(not w[4] for w in want.values())
    spans = {r["doc_id"]: r["text"] for r in decontaminate.contamination(docs, bench, remove="spans").collect()}
    for i, t in texts:
        assert len(decontaminate.words_of(spans[i])) == want[i][0] - want[i][1]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def brute_scores(texts):
    tokens = [WORD.findall(low(t)) + [" "] for _, t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    uni, bi = Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            uni.update(w)
            bi.update(zip(["  ", *w], w))
    total, distinct = sum(uni.values()), len(uni)
    begins = sum(not h for h in held)
    out = Counter()
    for (i, _), w, h in zip(texts, tokens, held, strict=True):
        base = score = 0.0
        for a, b in zip(["  ", *w], w):
            p = (uni[b] + 0.5) / (total + 0.5 * (distinct + 1))
            c = begins if a == "  " else uni[a]
            m = c**0.75 + 1
            level = 1 + math.floor(math.log(bi[a, b]) / math.log(1.5) + 1e-9) if bi[a, b] else 0
            pair = min(lm_scoring.level_counts()[level], uni[b], c)
            base += math.log10(p)
            score += math.log10((pair + m * p) / (c + m))
        out[i, h, len(w), sum(uni[x] > 0 for x in w), total, round(base, 4)] += 1
        yield i, h, score
    yield out


def test_lm_scoring(spark, sf, docs, odd):
    for frame, texts in ((spark.read.parquet(f"{sf}/documents.parquet"), docs), (odd, [r[:2] for r in ODD])):
        *scores, want = brute_scores(texts)
        exact, n = Counter(), {i: sum(r[2] * k for r, k in want.items() if r[0] == i) for i in {r[0] for r in want}}
        for i, _, x in scores:
            exact[i] += x
        for size in (lm_scoring.BROADCAST_BYTES, 0):
            rows = lm_scoring.score(frame, broadcast_bytes=size).collect()
            assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in rows) == want
            got = Counter()
            for r in rows:
                got[r["doc_id"]] += r["score"]
            # a false positive adds a level, at most a factor of about 1.5 to a share of the tokens
            assert all(-1e-6 <= got[i] - exact[i] <= 0.03 * n[i] + 2 for i in got)
            assert sum(got.values()) - sum(exact.values()) < 0.02 * abs(sum(exact.values()))
    assert lm_scoring.score(odd.limit(0)).count() == 0 and lm_scoring.score(odd.limit(0), broadcast_bytes=-1).count() == 0


def test_shards_do_not_change_scores(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["doc_id"]: r for r in lm_scoring.score(frame).collect()}
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(lm_scoring, "FLUSH", 10_000)
    known = {}
    for size in (lm_scoring.BROADCAST_BYTES, 0):
        for r in lm_scoring.score(frame, broadcast_bytes=size).collect():
            assert r["n_known"] == one[r["doc_id"]]["n_known"] and abs(r["base_score"] - one[r["doc_id"]]["base_score"]) < 1e-6
            assert abs(known.setdefault(r["doc_id"], r["score"]) - r["score"]) < 1e-6  # both ways probe the same filter


def test_importance(spark, sf, docs, odd):
    rows = queries.op2_quality_classifier(spark, sf).collect()
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    share = sum(q == 1 for q, _ in labels.values()) / len(labels)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == round(share * len(rows))
    assert min(r["gumbel_key"] for r in kept) >= max(r["gumbel_key"] for r in rows if not r["kept"]) - 1e-6
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == (1, 0)]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"], (1, 0))[0] == 0]
    assert np.mean(good) > 0.95 and (not junk or np.mean(junk) < 0.5 * np.mean(good))
    scaled = importance.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), length=512).collect()
    good = [r["kept"] for r in scaled if labels.get(r["doc_id"]) == (1, 0)]
    junk = [r["kept"] for r in scaled if labels.get(r["doc_id"], (1, 0))[0] == 0]
    assert np.mean(good) > 0.95 and (not junk or np.mean(junk) < 0.3)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(odd, empty).filter("kept").count() == len(ODD)
    assert importance.resample(odd.limit(0), empty).count() == 0


def brute_importance(texts, target):
    """n_grams and log weight of each text: sums over the hashed words and word pairs, in plain Python integers."""
    from xxhash import xxh64_intdigest

    full = (1 << 64) - 1

    def spread(x):
        x = (x ^ (x >> 32)) * 0x9E3779B97F4A7C15 & full
        x = (x ^ (x >> 29)) * 0xC2B2AE3D27D4EB4F & full
        return x ^ (x >> 32)

    found = []
    for _, text in texts:
        words = [xxh64_intdigest(w) for w in WORD.findall(low(text))]
        found.append([h % 65536 for h in words] + [spread((a * 0x9E3779B97F4A7C15 + b) & full) % 65536 for a, b in zip(words, words[1:])])
    raw, good = Counter(g for own in found for g in own), Counter(g for own, t in zip(found, target, strict=True) if t for g in own)
    sizes = [sum(x.values()) + 0.5 * 65536 for x in (good, raw)]
    ratio = lambda g: math.log((good[g] + 0.5) / sizes[0]) - math.log((raw[g] + 0.5) / sizes[1])
    return [(len(own), sum(map(ratio, own))) for own in found]


def test_importance_equals_brute_force(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    cases = [(spark.read.parquet(f"{sf}/documents.parquet"), labels, docs, good), (odd, spark.createDataFrame([(1, 1, 0), (9, 1, None), (5, 0, 0), (6, 1, 1), (9, 1, 0), (None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int"), [r[:2] for r in ODD], {1, 9})]
    for frame, marks, texts, target in cases:
        u = "(shiftrightunsigned(xxhash64(xxhash64(doc_id, text), 42), 11) + 0.5D) / 9007199254740992D"
        noise = Counter((r["doc_id"], r["text"], r["g"]) for r in frame.selectExpr("doc_id", "text", f"-ln(-ln({u})) AS g").collect())
        want = Counter()
        fractions = [r["quality"] == 1 for r in marks.collect()]
        weights = brute_importance(texts, [i in target for i, _ in texts])
        gumbel = {(i, t): g for i, t, g in noise}
        for (i, t), (n, w) in zip(texts, weights, strict=True):
            want[i, n, round(w, 4), round(w + gumbel[i, t], 4)] += 1
        rows = importance.resample(frame, marks).collect()
        got = Counter((r["doc_id"], r["n_grams"], round(r["log_weight"], 4), round(r["gumbel_key"], 4)) for r in rows)
        assert sum((got - want).values()) <= 0.01 * len(rows)  # a last digit may round either way
        k = round(sum(fractions) / len(fractions) * len(texts))
        least = sorted((r["gumbel_key"] for r in rows), reverse=True)[k - 1]
        assert all(r["kept"] == (r["gumbel_key"] >= least - 1e-6) for r in rows)


def test_ngrams_travel_packed():
    """Counts come back as they were, in eight bytes an n-gram at most where counts are small (a row of 40 bytes each before)."""
    rng = np.random.default_rng(3)
    for n, most in ((1, 1), (2, 300), (1000, 70_000), (200_000, 3)):
        hashes, counts = np.unique(rng.integers(0, 1 << 64, n, np.uint64)), rng.integers(1, most + 1, n)
        first, steps, held = lm_scoring.packed(hashes, counts)
        back = lm_scoring.unpacked(first, steps, held, n)
        assert np.array_equal(back[0], hashes) and np.array_equal(back[1], counts)
    assert len(steps) + len(held) <= 8 * n


def test_a_dealt_model_is_asked_in_packed_rows(spark, sf, monkeypatch):
    """texts are stored one row a batch, with a few bytes a token, and n-grams go to the shards in rows of many; each was a row that went there and back."""
    from pyspark.sql import functions as F

    kept, stored = {}, lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 20_000)
    frame = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    rows = lm_scoring.score(frame, broadcast_bytes=0).collect()
    batches, tokens = kept["lm-batches"], sum(r["n_tokens"] for r in rows)
    assert batches.count() <= 2 and batches.select(F.sum(F.octet_length("words"))).first()[0] <= 3.1 * (tokens + len(rows))
    for n in (np.zeros(0, np.int64), np.array([0, 0]), np.array([5, 2**40, 255])):
        assert np.array_equal(lm_scoring.whole(lm_scoring.planes(n), len(n)), n.astype(np.uint64))
    assert lm_scoring.cut(np.array([1, 2**63, 2**63 + 1], np.uint64), 2) == [(0, 0, 1), (1, 1, 3)] and lm_scoring.cut(np.zeros(0, np.uint64), 2) == []
