"""Embedders, model extraction with JSON recovery, and SQLite as a source."""

import json
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import models
from lorekeep.sources import sqlite


@pytest.mark.parametrize(("answer", "want"), [
    ('{"a": 1}', {"a": 1}), (' [1, 2] ', [1, 2]), ('Here:\n```json\n{"a": [1]}\n```\nbye', {"a": [1]}), ("```\n[3]\n```", [3]), ('so {"a": "}{", "b": ["]"]} and {"c": 1}', {"a": "}{", "b": ["]"]}),
    ('x "quoted { brace" y', None), ('{"a": "\\"}"} tail', {"a": '"}'}), ("[1, 2", None), ("{]", None), ("none", None), ("", None), (None, None), ("7", None), ('```json\nbroken\n``` {"ok": true}', {"ok": True}),
])
def test_json_recovery(answer, want):
    assert models.recovered(answer) == want


def test_backfill_embeds_what_lacks_a_vector_only(spark, tmp_path):
    log = str(tmp_path / "log")

    def factory():
        import os

        with open(f"{log}-made", "a") as f:
            f.write(f"{os.getpid()}\n")

        def embed(texts):
            with open(f"{log}-{os.getpid()}", "a") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            if any("bad" in t for t in texts):
                raise ValueError("model down")
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    rows = [(i, ("active", "pending", "archived")[i % 3], "secret" if i == 4 else "public", f"t{i}", "bad" if i == 199 else f"content {i}") for i in range(200)]
    memories = spark.createDataFrame(rows, "id long, status string, sensitivity string, title string, content string").repartition(4)
    vectors = spark.createDataFrame([(i, [0.0, 0.0], "m" if i < 50 else "old") for i in range(100)], "id long, embedding array<float>, model string")
    got = models.backfilled(memories, vectors, "m", factory, batch=16).collect()
    lacked = {i for i, status, sense, *_ in rows if status != "archived" and sense != "secret" and i >= 50}
    new = [r for r in got if r["model"] == "m" and r["id"] >= 50]
    seen = [json.loads(x) for p in tmp_path.glob("log-[0-9]*") for x in p.read_text().splitlines()]
    assert Counter(seen) == Counter(f"t{i}\n{rows[i][4]}" for i in lacked)  # each once, and no other
    pids = (tmp_path / "log-made").read_text().split()
    assert len(pids) == len(set(pids)) and len(got) == 100 + len(new)  # one model a worker
    assert {r["id"] for r in new} <= lacked - {199} and len(new) >= len(lacked) - 16 and all(r["embedding"][0] == len(f"t{r['id']}\n{rows[r['id']][4]}") for r in new)
    fallen = {r["id"]: r for r in models.embedded(memories.filter("id >= 198"), "m2", factory, batch=1).collect()}
    assert fallen[198]["model"] == "m2" and fallen[199]["model"] == "hash:384" and len(fallen[199]["embedding"]) == 384


def test_model_extraction_and_its_fallback(spark):
    memory = {"title": "T", "content": "C", "kind": "odd", "tags": ["a"] * 9, "confidence": 7, "importance": "high"}
    answers = {"one": json.dumps([memory | {"title": f"T{i}"} for i in range(15)]), "two": "no json here", "three": 'Sure: {"memories": [{"title": " "}, {"title": "K", "content": "V", "kind": "fact", "sensitivity": "secret"}, 5]}', "four": "FAIL"}

    def factory():
        def ask(prompts):
            if any("four" in p for p in prompts):
                raise TimeoutError
            return [next(a for k, a in answers.items() if k in p) for p in prompts]

        return ask

    turns = spark.createDataFrame([(k, t, "user", f"{k} 记住：部署之前先备份数据库" if t else k) for k in answers for t in range(2)], "conv_id string, turn long, role string, text string")
    rows = models.model_extract(turns, "llm", factory, "Extract: {transcript}", batch=1).collect()
    found = {k: [r for r in rows if r["conv_id"] == k] for k in answers}
    assert [r["title"] for r in sorted(found["one"], key=lambda r: int(r["title"][1:]))] == [f"T{i}" for i in range(12)]
    r = found["one"][0]
    assert (r["kind"], r["sensitivity"], len(r["tags"]), r["confidence"], r["importance"], r["method"]) == ("fact", "private", 6, 1.0, 0.5, "model")
    assert [(r["title"], r["sensitivity"]) for r in found["three"]] == [("K", "secret")]
    assert {r["method"] for r in found["two"] + found["four"]} == {"rules"} and found["two"] and found["four"]


def test_harvest_and_upkeep(spark):
    answers = [{"title": f"T{i}", "content": "c"} for i in range(3)]

    def factory():
        return lambda prompts: [json.dumps(answers) if "good" in p else None for p in prompts]

    docs = spark.createDataFrame([(1, "good text"), (2, "good too"), (3, "bad"), (4, None)], "id long, content string")
    got = models.harvest(docs, spark.createDataFrame([(" t1 ",), (None,)], "title string"), "h", factory).collect()
    assert sorted((r["doc"], r["title"], r["status"]) for r in got) == [(1, "T0", "pending"), (1, "T2", "pending")]
    rows = [(1, "2020-01-01", False), (2, "2020-01-01", True), (3, None, None), (4, "2030-01-01", False)]
    memories = spark.createDataFrame([(i, "t", "c", "active", "public", p, e) for i, e, p in rows], "id long, title string, content string, status string, sensitivity string, pinned boolean, expires string").withColumn("expires_at", F.col("expires").cast("timestamp"))
    tables = {"memories": memories, "vectors": spark.createDataFrame([(1, [1.0], "m")], "id long, embedding array<float>, model string"), "links": spark.createDataFrame([(1, 5), (2, 5)], "memory long, entity long"), "edges": spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")}
    left = models.maintained(tables, "2024-01-01", "m", lambda: lambda texts: [[2.0] for _ in texts])
    assert sorted(r["id"] for r in left["memories"].collect()) == [2, 3, 4] == sorted(r["id"] for r in left["vectors"].collect())
    assert [(r["memory"], r["entity"]) for r in left["links"].collect()] == [(2, 5)] and [(r["source"], r["target"]) for r in left["edges"].collect()] == [(2, 3)]


def test_vault(spark):
    import time

    from lorekeep.operators import vault

    kept, key = vault.create(spark, "main", "one two", rounds=1 << 10)
    rows = spark.createDataFrame([(1, "secret", "body"), (2, "public", "open"), (3, "secret", None)], "id long, sensitivity string, content string")
    sealed = vault.levelled(rows, key).cache()
    bodies = {r["id"]: r["content"] for r in sealed.collect()}
    assert bodies[1].startswith("sealed:") and "body" not in bodies[1] and bodies[2] == "open" and bodies[3] is None
    kept = vault.add_wrapper(spark, kept, key, "spare", "three", rounds=1 << 10)
    kept = vault.remove_wrapper(kept, "main")
    again = vault.unlock(spark, kept, "three")
    assert {r["id"]: r["content"] for r in vault.opened(sealed, again).collect()} == {1: "body", 2: "open", 3: None}
    for wrong in ("one two", ""):
        with pytest.raises(PermissionError):
            vault.unlock(spark, kept, wrong)
    with pytest.raises(ValueError, match="last"):
        vault.remove_wrapper(kept, "spare")
    turned = vault.levelled(sealed.withColumn("sensitivity", F.when(F.col("id") == 1, "private").otherwise("secret")), again)
    shown = {r["id"]: r["content"] for r in turned.collect()}
    assert shown[1] == "body" and shown[2].startswith("sealed:") and vault.opened(turned, again).filter("id = 2").first()["content"] == "open"
    other, fresh, new = vault.rekeyed(spark, sealed, again, "main", "four", rounds=1 << 10)
    other = other.cache()
    assert vault.opened(other, new).filter("id = 1").first()["content"] == "body" and vault.opened(other, again).filter("id = 1").first()["content"] is None
    assert vault.unlock(spark, fresh, "four").get() == new.get() and new.get() not in repr(new) + repr(fresh)
    short = vault.Unlocked(key.get(), ttl=0.05)
    time.sleep(0.1)
    with pytest.raises(PermissionError):
        short.get()


def test_sqlite_sessions(spark, tmp_path):
    path = str(tmp_path / "s p#.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT, directory TEXT, time_updated INTEGER, time_archived INTEGER)")
        db.execute("CREATE TABLE message (id TEXT, session_id TEXT, role TEXT, time_created INTEGER)")
        db.execute("CREATE TABLE part (message_id TEXT, time INTEGER, text TEXT)")
        db.executemany("INSERT INTO session VALUES (?, ?, ?, ?)", [("a", "/a", 1000, None), ("b", "/b", 2000, None), ("c", "/c", 3000, 1)])
        db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [(f"m{s}{i}", s, "user" if i % 2 == 0 else "assistant", 100 * i) for s in "abc" for i in range(3)])
        db.executemany("INSERT INTO part VALUES (?, ?, ?)", [(f"m{s}{i}", t, f"{s}{i} part {t}") for s in "abc" for i in range(3) for t in (2, 1)])
    table = sqlite.sqlite_table(spark, path, "message", rows=2)
    assert table.count() == 9 and table.rdd.getNumPartitions() == 5 and table.filter("time_created > 100 and role = 'user'").count() == 3
    got, cursor = sqlite.database_sessions(spark, path)
    assert {r["text"] for r in got.filter("session = 'a' and role = 'user'").collect()} == {"a0 part 1\na0 part 2", "a2 part 1\na2 part 2"} and got.count() == 6 and cursor == 3000
    with sqlite3.connect(path) as db:
        db.execute("UPDATE session SET time_updated = 4000 WHERE id = 'a'")
    got, cursor = sqlite.database_sessions(spark, path, cursor)
    assert {r["session"] for r in got.select("session").collect()} == {"a"} and cursor == 4000
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE odd (n INTEGER, x REAL, b BLOB, free)")
        db.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", [("word", 1, "text", 5), (None, "x", b"\xff", None), (2.0, 2.5, None, b"\xff")])
    assert [tuple(r) for r in sqlite.sqlite_table(spark, path, "odd").orderBy(F.col("x").desc_nulls_last()).select("n", "x", "free").collect()] == [(2, 2.5, "�"), (None, 1.0, "5"), (None, None, None)]
    assert sqlite.sqlite_table(spark, path, "odd").filter("n = 99").count() == 0


def test_tokens_are_hashed_once(monkeypatch):
    """A word of many texts is hashed once a worker, not once a text."""
    from lorekeep.operators import documents

    asked, plain = [], documents.fnv1a
    monkeypatch.setattr(documents, "fnv1a", lambda text: asked.append(text) or plain(text))
    documents.places.cache_clear()
    first = documents.hash_vector("seldom words seldom")
    assert documents.hash_vector("seldom words seldom") == first and sorted(asked) == ["seldom", "seldom#2", "words", "words#2"]
    documents.places.cache_clear()
