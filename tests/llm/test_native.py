"""Native operators: SQL where there is one, brute force elsewhere."""

import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import license_scan, line_dedup, quality_rules, queries, url_filters

from .test_free_style import ODD, brute_hits, brute_simhash, check_packing


def tables(sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = tables(sf).execute(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(want) == Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, n_words long, kept int, row_key2 string")


def test_names_of_work_columns_pass_through(spark):
    from lorekeep.llm import simhash

    docs = spark.createDataFrame([(1, "a b c. " * 30 + "d e", "kept", 5, 6), (2, "x", "k", 1, 2)], "doc_id long, text string, __lk_text string, __LK_words int, __lk_row int")
    rows = quality_rules.judge(docs).collect()
    assert sorted((r["__lk_text"], r["__LK_words"], r["__lk_row"]) for r in rows) == [("k", 1, 2), ("kept", 5, 6)]
    assert quality_rules.accepted(docs).columns == docs.columns and quality_rules.accepted(docs).count() <= 2
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_url_filters_long_hosts(spark):
    import time

    hosts = ["a." * 50_000 + "example.net", "b" * 100_000 + ".org", "." * 20_000 + "net", "net", "x.example.com."]
    pages = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)] + [(9, "http://net" + "/en" * 40_000)], "page_id long, url string")
    rules = url_filters.rules_frame(spark, queries.URL_RULES)
    url_filters.judge(pages.limit(1), rules).collect()
    start = time.time()
    got = {r["page_id"]: r["rule"] for r in url_filters.judge(pages, rules).collect()}
    assert got == {0: "example.net/en/", 1: None, 2: "net/", 3: "net/", 4: None, 9: "net/"} and time.time() - start < 10


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, odd):
    texts = [r[:2] for r in ODD] + [(20, "a b c d\n" * 40), (21, " ".join(f"w{i % 40} w{i % 7}" for i in range(900))), (22, "\n\n a\n a\na \n")]
    rows = quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"]) for r in rows)
    want = Counter()
    for doc_id, text in texts:
        m = brute_quality(text)
        want[doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    assert got == want
    judged = quality_rules.judge(odd)
    assert judged.columns.count("n_words") == 1 and judged.count() == len(ODD) and quality_rules.judge(odd.limit(0)).count() == 0
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, quality_rules.accepted(odd).collect())) == sorted(key(r) for r in judged.collect() if r["kept"])
    assert quality_rules.accepted(odd).columns == odd.columns and quality_rules.accepted(odd.limit(0)).count() == 0
    table = quality_rules.ablations(judged).collect()
    assert len(table) == 8
    bits = [r["fail_bits"] for r in judged.collect()]
    for r in table:
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r["rule"])
        assert (r["failed"], r["only"], r["kept"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), bits.count(0))


def test_very_long_clean_document_stays(spark):
    # measures as the ledger has them; the text of a million words itself is made by Spark
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_001)), lambda i: F.translate(F.lower(F.hex(i * 2654435761 % 4294967296)), "0123456789", "ghijklmnop")), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    row = quality_rules.judge(docs).drop("text").first()
    assert row["n_words"] == 1_000_001 and row["fail_bits"] == 4 and row["kept"]
    assert quality_rules.accepted(docs).count() == 1


def brute_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, "allow"))


def test_url_filters(spark):
    rules = [("net", "/", "block"), ("b.net", "/en", "allow"), ("b.net", "", "block"), ("a.b.net", "/", "allow"), ("org", "/fr/", "block"), ("org", "/fr/", "block")]
    urls = ["http://A.b.Net/en/1", "http://b.net", "http://b.net?x=/", "https://xb.net/en", "ftp://x.org/fr/", "http://x.org/fr", "no url", "", None, "http:///x", "http://a.org/fr/#://", "x://y://z.net/", "http://b.net/en\nglish"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("page_id", "page_id")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge(pages, url_filters.rules_frame(spark, rules)).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge(pages.limit(0), url_filters.rules_frame(spark, rules)).count() == 0
    nothing = url_filters.rules_frame(spark, rules).limit(0)
    assert url_filters.judge(pages, nothing).filter("rule is not null or verdict <> 'allow'").count() == 0


def lines_in(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def similar_line_groups(lines):
    """Components of distinct lines, by all pairs of their sets of 5-character shingles (sizes and an index only save time)."""
    sets = [frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in lines]
    parent, where = list(range(len(lines))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        both = Counter(j for s in own for j in where[s])
        for j, n in both.items():
            if 9 * n >= 4 * (len(own) + len(sets[j])):
                parent[find(i)] = find(j)
        for s in own:
            where[s].append(i)
    groups = defaultdict(list)
    for i in range(len(lines)):
        groups[find(i)].append(lines[i])
    return list(groups.values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_line_dedup(spark, sf, folder):
    from pathlib import Path

    frame = spark.read.parquet(f"{Path(sf).parent / folder}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    first = {}
    for doc_id, text in texts:
        for line in lines_in(text):
            first[line] = min(first.get(line, doc_id), doc_id)
    groups = [g for g in similar_line_groups(sorted(first))]
    rows = line_dedup.dedup_lines(frame).collect()
    left = {}
    for r in rows:
        for line in lines_in(r["text"]):
            assert line not in left
            left[line] = r["doc_id"]
    # one line of each group is left, that of the smallest document; few links of all are missed
    wrong = sum([left[x] for x in g if x in left] != [min(first[x] for x in g)] for g in groups if len(g) > 1)
    assert wrong <= max(1, 0.01 * sum(len(g) > 1 for g in groups)) and all([left[g[0]]] == [first[g[0]]] for g in groups if len(g) == 1)
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and len(rows) == len(texts)


def test_line_dedup_cases(spark, odd):
    near = " ".join(f"quick{i} brown fox{i}" for i in range(12)) + " dog again"
    texts = [(1, f"x\n\n{near}\nx"), (2, near.replace("dog", "cat")), (3, None), (4, ""), (5, "one\ntwo"), (5, "one\ntwo"), (5, "one\ntwo"), (0, "two"), (None, "x\nlast")]
    want = Counter([(1, f"x\n\n{near}", 3, 1), (2, "", 1, 1), (3, None, 0, 0), (4, "", 0, 0), (5, "one", 2, 1), (5, "", 2, 2), (5, "", 2, 2), (0, "two", 1, 0), (None, "last", 2, 1)])
    for kind, cast in (("long", lambda i: i), ("string", lambda i: None if i is None else f"doc{i}")):
        frame = spark.createDataFrame([(cast(i), t, 7, "y") for i, t in texts], f"doc_id {kind}, text string, places int, Row_Key string")
        got = line_dedup.dedup_lines(frame)
        assert got.columns == ["doc_id", "text", "places", "Row_Key", "n_lines", "n_removed_lines"]
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in got.collect()) == Counter((cast(i), *rest) for i, *rest in want.elements())
        assert {(r["places"], r["Row_Key"]) for r in got.collect()} == {(7, "y")}
    rows = line_dedup.dedup_lines(spark.createDataFrame([(None, "x\nonly here"), (None, "only here"), (None, "only here")], "doc_id long, text string")).collect()
    assert Counter(x for r in rows for x in lines_in(r["text"])) == Counter(["x", "only here"])
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_large_buckets(spark, monkeypatch):
    import random

    rng = random.Random(8)
    base = [f"w{i}x{rng.randrange(99)}" for i in range(40)]
    lines = []
    for _ in range(150):
        words = list(base)
        for i in rng.sample(range(40), 3):
            words[i] = f"q{rng.randrange(10**6)}"
        lines.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = sorted(min(map(lines.index, g)) for g in similar_line_groups(lines))
    assert 1 < len(want) < 150
    left = lambda: sorted(r["doc_id"] for r in line_dedup.dedup_lines(frame).collect() if r["text"])
    found = left()
    # at the edge of similarity a bucket is compared with a few of its lines only: nothing is removed wrongly, few links are missed
    assert set(want) <= set(found) and len(found) - len(want) <= 0.05 * len(lines)
    exact = sorted(r["doc_id"] for r in line_dedup.dedup_lines(frame, exact=True).collect() if r["text"])
    assert set(want) <= set(exact) <= set(found) and len(exact) - len(want) <= 0.02 * len(lines)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert left() == found


def test_line_dedup_unlike_lines_stay(spark):
    lines = ["https://example.com/one", "https://example.org/entirely/different", "authentication", "authenticity", "1234567890001", "1234567890999"]
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert lines_in(rows[0]["text"]) == lines


def brute_groups(lines):
    """Components of distinct lines of similar shingles at every position, each as a set."""
    sets = {x: {y[i : i + 5] for y in [x] for i in range(len(y) - 4)} or {x} for x in lines}
    groups = []
    for x in lines:
        near = [g for g in groups if any(9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])) for y in g)]
        groups = [g for g in groups if g not in near] + [{x}.union(*near)]
    return groups


def test_line_dedup_every_position(spark):
    import random

    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    thai = "กขคงจฉชซญฐณดตถทนบปผพฟมยรลวศสหอ"
    words = [draw("abcdefghijklmnopqrstuvwxyz", 5) for _ in range(16)]
    alone = [head + draw(letters, n) for head, letters, n in [("https://example.com/", "abcdef0123456789", 40), ("id,name,city,", "abcdefgh,", 50), ("ประเทศไทย", thai, 60), ('{"key":"value","', "xyz:,", 90)] for _ in range(4)]
    alone += ["ab ab " + draw("klmnop", 25), "ab ab " + draw("klmnop", 25)]
    near = [" ".join(words), " ".join([*words[:7], "other", *words[8:]]), "chapter seventeen", "chapter seventeem", "abcdefgh", "abcdefghi", "-" * 10, "-" * 40, "-" * 200]
    near += [f"{x}{end}" for x in (draw(thai, 70), draw("abcdef0123456789", 120), ",".join(draw("abcde", 4) for _ in range(12))) for end in ("", "zq")]
    lines = alone + near
    groups = brute_groups(lines)
    assert len(groups) < len(lines) and all({x} in groups for x in alone) and not any({x} in groups for x in near)
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["text"] for r in rows if r["text"]} == {min(g, key=lines.index) for g in groups}


def test_line_dedup_repeated_phrases(spark):
    """Lines of equal shingle sets are linked whatever their lengths."""
    import random

    rng = random.Random(6)
    lines = []
    for n in (3, 30, 40, 60, 77, 90, 100, 120):
        phrase = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
        lines += [(phrase * 200)[:size] for size in (40 + 2 * n, 220 + n, 480, 3000, 70_000)]
    want = sorted(min(map(lines.index, g)) for g in brute_groups(lines))
    assert len(want) == 8
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect() if r["text"]) == want


def test_line_dedup_very_long_lines(spark):
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(330_000))
    lines = [long, long[:1_500_000] + "another end of this line", long[::-1], long[: len(long) // 3]]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect() if r["text"]) == sorted(min(map(lines.index, g)) for g in brute_groups(lines))


@pytest.mark.parametrize(("least", "most"), [(1, 15), (16, 60), (61, 250), (251, 500), (501, 5000)])
def test_line_dedup_recall_by_length(spark, least, most):
    """Of all similar pairs of different lines, against all pairs, at least 97 in a hundred end in one group."""
    import random

    rng = random.Random(least)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    lines = []
    while len(lines) < 400:
        base = ""
        while len(base) < least or (len(base) < most and rng.random() < 0.9):
            base += rng.choice(words) + " "
        for _ in range(4):
            line = list(base[:most].rstrip() or "x")
            for _ in range(rng.randrange(1, 2 + len(line) // 60)):
                i = rng.randrange(len(line)) if most > 60 else len(line)
                line[i : i + rng.randrange(3)] = rng.choice(words)[: rng.randrange(1, 4) if most > 60 else 1]
            lines.append("".join(line))
    lines = list(dict.fromkeys(x for x in lines if x.strip()))
    groups = brute_groups(lines)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    left = {r["doc_id"] for r in got.collect() if r["text"]}
    want = {min(map(lines.index, g)) for g in groups}
    links = sum(len(g) - 1 for g in groups)
    assert links >= 50 and want <= left and len(left) - len(want) <= 0.03 * links


def test_line_dedup_documents_every_position(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).select("doc_id", "text")
    lines = list(dict.fromkeys(x for r in docs.collect() for x in (r["text"] or "").split("\n") if x.strip()))
    left = Counter(x for r in line_dedup.dedup_lines(docs).collect() for x in (r["text"] or "").split("\n") if x.strip())
    groups = brute_groups(lines)
    assert max(left.values()) == 1 and sum(sum(x in left for x in g) != 1 for g in groups) <= 0.01 * len(groups)


def test_license_scan(spark, sf):
    notice = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = sorted(f for f, n in notice.items() if n in docs[r["doc_id"]].split("\n"))
        assert r["families"] == ",".join(own)
    model = license_scan.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [(1, None), (2, ""), (3, "The licensed plumber fixed the sink."), (4, "MIT\nreleased under the mit license"), (4, "MIT\nreleased under the mit license"), (None, "All rights reserved.")]
    found = Counter((r["doc_id"], r["n_paragraphs"], r["n_license"], r["family"]) for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect())
    assert found == Counter([(1, 0, 0, None), (2, 0, 0, None), (3, 1, 0, None), (4, 2, 1, "mit"), (4, 2, 1, "mit"), (None, 1, 1, "proprietary")])


def test_wrapped_licenses(spark, sf):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish and sell copies."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    prose = "The river was calm that evening and nobody spoke.\nWe walked on until the lights of the town were gone."
    texts, want = [(0, prose)], {0: (set(), 0)}
    for family, notice in (("mit", mit), ("bsd", bsd), ("gpl", gpl)):
        for width in (80, 72, 40):
            for lead in ("", "# ", " * ", "// "):
                texts.append((len(texts), prose + "\n\n" + "\n".join(lead + x for x in textwrap.wrap(notice, width)) + "\n\n" + prose))
                want[len(want)] = ({family}, 1)
    texts.append((len(texts), "Copyright (c) 2019 Some One. All rights reserved.\n\n" + "\n".join(textwrap.wrap(bsd, 80))))
    want[len(want)] = ({"bsd", "proprietary"}, 2)
    model = license_scan.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: (set(filter(None, r["families"].split(","))), r["n_license"]) for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got == want


def test_pipeline(spark, sf):
    from lorekeep.session import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    held, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, sf), f"test-{name}")
        assert now.columns == docs.columns
        held.append(now)
    texts, kept, lines, near, clean = map(read, held)
    measures = {i: brute_quality(t) for i, t in texts.items()}
    assert set(kept) <= {i for i, m in measures.items() if not (m[0] < 50 or 100 * m[4] > 50 * m[0])}
    assert set(lines) == set(kept) and max(Counter(x for t in lines.values() for x in t.split("\n") if x.strip()).values()) == 1
    assert set(near) == {c for _, _, c in brute_simhash(list(lines.items()))}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean) == {i for i, t in near.items() if not brute_hits(t, items)[4]}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, sf).collect(), list(clean.items()), 0.95)


def test_keep_one_of_each_root(spark):
    from lorekeep.llm import simhash

    one, two = " ".join(f"first{i} word" for i in range(60)), " ".join(f"other{i} thing" for i in range(60))
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")
    assert Counter(map(tuple, simhash.keep_one(docs).collect())) == Counter([(1, one), (1, two)])
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    near = [" ".join(words), *(" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 400, 8))]
    docs = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    found = simhash.judged(docs, 2, 3, 42).select("fp", "root").distinct().collect()
    assert len(found) > len({r["root"] for r in found}) == simhash.keep_one(docs).count()


def test_clashing_columns_pass_through(spark):
    from lorekeep.llm import decontaminate, simhash, token_counts

    names = ["row_key", "places", "new_text", "hit_words", "q_words", "lh", "fp", "n_grams", "piece_row", "label", "host", "bucket"]
    docs = spark.createDataFrame([(1, "some words here", *range(12)), (2, None, *[None] * 12)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    want = {(r["doc_id"], *(r[n] for n in names)) for r in docs.collect()}
    for out in (line_dedup.dedup_lines(docs), quality_rules.judge(docs), simhash.keep_one(docs), token_counts.count_tokens(docs, queries.vocabulary()), decontaminate.contamination(docs, bench, remove="spans")):
        assert {(r["doc_id"], *(r[n] for n in names)) for r in out.collect()} == want


def test_license_lines_equal_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = license_scan.fit(frame)
    lines = [x for r in frame.orderBy("doc_id").limit(40).collect() for x in lines_in(r["text"])][:300]
    lines += [text for _, text in license_scan.variants()] + ["", "  ", "license license license", "the MIT License is a licence", "w " * 5000 + "Released under the MIT License."]

    def judged(line):
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if w]
        grams = list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))
        if not any(g in model.weights for g in grams):
            return 0, 0, None
        found = model.probabilities(grams)
        best = max(found, key=lambda f: (round(found[f], 6), f))
        own = [set(re.findall("[a-z0-9]+", t.lower())) for f, t in license_scan.TEMPLATES if f == best]
        sure = best != license_scan.NONE and found[best] >= model.threshold - 1e-6 and any(len(o & set(words)) >= license_scan.CONFIRM * len(o) for o in own)
        return int(sure), int(best != license_scan.NONE and not sure), best if sure else None

    rows = license_scan.scan(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: (r["n_license"], r["n_unknown"], r["family"]) for r in rows}
    assert got == {i: judged(x) for i, x in enumerate(lines)} and sum(v[0] for v in got.values()) > 200
    assert license_scan.scan(frame.select("doc_id", "text").limit(0)).count() == 0
    clash = license_scan.scan(frame.limit(3).selectExpr("cast(doc_id AS string) AS doc_id", "text", "1 AS place", "2 AS row_key", "3 AS family"), model)
    assert [type(r["doc_id"]) for r in clash.collect()] == [str] * 3


def test_line_dedup_leaves_no_candidate_out(spark, monkeypatch):
    """how many look-alikes are tried first changes no result; lines of a bucket met the few that look most like them only."""
    import random

    rng = random.Random(8)
    base = [f"w{i}x{rng.randrange(99)}" for i in range(40)]
    changed = lambda: [f"q{rng.randrange(10**6)}" if i in chosen else w for chosen in [rng.sample(range(40), 3)] for i, w in enumerate(base)]
    frame = spark.createDataFrame([(i, " ".join(changed())) for i in range(120)], "doc_id long, text string")
    left = lambda **more: sorted(r["doc_id"] for r in line_dedup.dedup_lines(frame, **more).collect() if r["text"])
    whole = left(exact=True)
    monkeypatch.setattr(line_dedup, "BEST", 1)
    assert left() == whole != left(exact=False)


def near_lines(seed, count, changed, words=40):
    """Lines of the same words but for some changed ones each."""
    import random

    rng = random.Random(seed)
    base = [f"w{i}x{rng.randrange(99)}" for i in range(words)]
    return [" ".join(f"q{rng.randrange(10**6)}" if i in chosen else w for chosen in [rng.sample(range(words), changed)] for i, w in enumerate(base)) for _ in range(count)]


def test_line_sketches_rule_out_no_similar_pair():
    """The op4 finding: a sketch rules out lines that only resemble each other, and never two similar ones, of any length."""
    import numpy as np

    from lorekeep.llm import line_signatures

    far = 0
    for seed, (count, changed, words) in enumerate([(60, 1, 40), (60, 2, 40), (60, 4, 40), (60, 2, 9), (30, 12, 300), (30, 40, 300), (12, 300, 3000)]):
        lines = [*near_lines(seed, count, changed, words), "a", "ab", "-" * 50]
        keys, shift = line_signatures.shingle_sets(lines)
        odd, sizes = line_signatures.odd_bits(keys, shift, len(lines)), np.bincount((keys >> shift).astype(int))
        sets = [{y[i : i + 5] for y in [x] for i in range(len(y) - 4)} or {x} for x in lines]
        a, b = np.triu_indices(len(lines), 1)
        can = line_signatures.may_be_similar(sizes[a], sizes[b], odd[a], odd[b], *line_dedup.SIMILAR)
        similar = np.array([5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in zip(a, b, strict=True)])
        assert can[similar].all()
        far += words == 40 and changed == 4 and can.sum() < 0.1 * len(a) and not similar.all()
    assert far == 1


def test_line_dedup_resembling_lines_make_few_pairs(spark, monkeypatch):
    """The op4 finding: pairs that reach the texts grew with the square of a group of lines that resemble each other (3,724,931 on check_h)."""
    made = []
    verified = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda texts, pairs, name: made.append(pairs.count()) or verified(texts, pairs, name))
    lines = near_lines(3, 200, 5)
    assert len(similar_line_groups(lines)) > 190
    left = [r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if r["text"]]
    assert sorted(r["doc_id"] for r in left) == sorted(min(map(lines.index, g)) for g in similar_line_groups(lines))
    assert len(made) == 3 and made[-1] < 200


def test_line_signatures_read_a_batch_in_parts(monkeypatch):
    """The pipeline finding: a batch of texts was held whole as lines, in every worker; parts of it give the same signatures."""
    import pyarrow as pa

    from lorekeep.llm import line_signatures

    texts = [None, "", *(f"{x}\nshort {i}" for i, x in enumerate(near_lines(4, 40, 5)))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    rows = lambda: sorted((r["lh"], r["n"], r["kind"], r["minima"]) for b in line_signatures.signed(iter([batch])) for r in b.to_pylist())
    whole, split = rows(), []
    lines_in_text = line_signatures.lines_in
    monkeypatch.setattr(line_signatures, "lines_in", lambda text: split.append(text) or lines_in_text(text))
    monkeypatch.setattr(line_signatures, "SPLIT", 2000)
    next(line_signatures.signed(iter([batch])))
    assert 0 < len(split) < 20 and rows() == whole


def test_line_signatures_come_in_small_batches(spark, monkeypatch):
    """The pipeline finding: texts travelled 10,000 at a time; the session's own setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: seen.append((name, spark.conf.get(key))) or stored(df, name))
    line_dedup.removals(spark.createDataFrame([(1, "one\ntwo"), (2, "two")], "doc_id long, text string"), True)
    assert ("line-signatures", str(line_dedup.TEXTS)) in seen and {x for name, x in seen if name != "line-signatures"} == {before} == {spark.conf.get(key)}
