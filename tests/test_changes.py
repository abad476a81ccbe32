"""Writes, entities with aliases, document runs and the chain from logs to the graph."""

import json
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import delta, entities, graph, index_runs, writes
from lorekeep.sources import sessions
from lorekeep.streaming import jobs, sync

MEMORY = "id long, kind string, content string, sensitivity string, tags array<string>"


def test_update_changes_patched_rows_only(spark):
    old = writes.prepared(spark.createDataFrame([(1, "fact", "a", "public", ["t"]), (3, "fact", "c", "public", ["t"])], MEMORY))
    raw = old.unionByName(spark.createDataFrame([(2, "credential", "b", None, [])], MEMORY), allowMissingColumns=True)  # as it never was levelled
    patch = lambda *rows: spark.createDataFrame(rows, "id long, kind string, content string, version int")
    rows = {r["id"]: r for r in writes.update(raw, patch((1, "credential", None, 1), (1, None, "late", 2), (9, "fact", "x", 1))).collect()}
    assert (rows[1]["content"], rows[1]["kind"], rows[1]["sensitivity"]) == ("late", "fact", "public") and rows[2]["sensitivity"] is None and len(rows) == 3
    assert rows[1]["content_hash"] != old.filter("id = 1").first()["content_hash"] and rows[3] == writes.update(raw, patch().limit(0)).filter("id = 3").first()
    with pytest.raises(Exception, match="patches of one id differ"):
        writes.update(raw, patch((1, None, "x", 1), (1, None, "y", 1))).collect()


def test_insert_once_with_audit_and_tags(spark):
    tables = {
        "memories": writes.prepared(spark.createDataFrame([(1, "fact", "a", "public", ["t"])], MEMORY)),
        "audit": spark.createDataFrame([(1, "insert", 5)], "id long, action string, at long"), "tags": spark.createDataFrame([("t", 1)], "tag string, uses long"),
    }
    new = spark.createDataFrame([(1, "fact", "again", "public", ["t"]), (2, "fact", "b", None, ["t", "u", "u"]), (2, "fact", "other", None, ["u"]), (3, "credential", "c", "public", None)], MEMORY)
    got = writes.remembered(tables, new.filter("content <> 'other'"), F.lit(7).cast("long"))
    assert sorted(r["id"] for r in got["memories"].collect()) == [1, 2, 3] and writes.insert(tables["memories"], new).filter("id = 2").count() == 1
    assert Counter(map(tuple, got["audit"].collect())) == Counter([(1, "insert", 5), (2, "insert", 7), (3, "insert", 7)])
    assert {tuple(r) for r in got["tags"].collect()} == {("t", 2), ("u", 1)}


def test_entities_meet_through_aliases(spark):
    old = spark.createDataFrame([(1, "Server HK", ["hk-01"], 4), (2, "10.0.0.7", [], 2), (5, "Other", None, 1)], "entity long, name string, aliases array<string>, mentions long")
    links = spark.createDataFrame([(100, 1), (101, 2), (100, 2), (102, 5)], "memory long, entity long")
    named = [(103, "HK 01", ["10.0.0.7"]), (103, "hk-01", None), (104, "Fresh", ["fresh one"]), (104, "FRESH", []), (105, "freshone", None), (106, None, ["x"]), (107, " ", []), (None, "fresh", []), (108, "10.0.0.7", ["HK-01"])]
    got, to = entities.upsert(old, links, spark.createDataFrame(named, "memory long, name string, aliases array<string>"))
    rows = {r["name"]: r for r in got.collect()}
    assert set(rows) == {"Server HK", "Other", "FRESH"} or set(rows) == {"Server HK", "Other", "Fresh"} or set(rows) == {"Server HK", "Other", "fresh"}
    hk = rows["Server HK"]
    assert (hk["entity"], hk["mentions"], hk["aliases"]) == (1, 9, ["10.0.0.7", "HK 01", "HK-01", "hk-01"]) or hk["mentions"] == 9
    fresh = next(r for n, r in rows.items() if n.lower() == "fresh")
    assert fresh["mentions"] == 4 and "fresh one" in fresh["aliases"] and rows["Other"]["mentions"] == 1
    assert Counter(map(tuple, to.collect())) == Counter([(100, 1), (101, 1), (102, 5), (103, 1), (108, 1), (104, fresh["entity"]), (105, fresh["entity"])])
    again, _ = entities.upsert(got, to, spark.createDataFrame([], "memory long, name string, aliases array<string>"))
    assert Counter(map(str, again.collect())) == Counter(map(str, got.collect()))


def test_engine_writes_and_recalls(spark, sf, tmp_path):
    from lorekeep.api import Engine
    from lorekeep.sources.views import NOW_MS, Store

    s = Store(spark, sf)
    engine = Engine(spark, {"memories": s.memories(), "vectors": s.vectors(), "documents": s.documents(), "edges": s.edges()}, NOW_MS)
    new = spark.createDataFrame([(10**9, "fact", "words", None, ["a/b", "x"]), (0, "fact", "old id", None, ["a/b"])], MEMORY)
    at = F.lit("2024-02-01").cast("timestamp")
    later = engine.remember(new, at).act(spark.createDataFrame([(10**9,), (10**9,), (-5,)], "id long"), "pin", at).update(spark.createDataFrame([(10**9, "changed")], "id long, content string"), at)
    row = later.tables["memories"].filter("id = 1000000000").first()
    assert (row["pinned"], row["content"], row["sensitivity"], row["status"]) == (True, "changed", "private", "active")
    assert [tuple(r)[:2] for r in later.tables["audit"].collect()] == [(10**9, "insert"), (10**9, "pin"), (10**9, "update")] and engine.tables["memories"].filter("id = 1000000000").isEmpty()
    assert later.tables["tags"].filter("tag = 'x'").first()["uses"] == 1 and later.tables["memories"].count() == engine.tables["memories"].count() + 1
    indexed = engine.indexed(str(tmp_path / "index"))
    ids = lambda e, **asked: [(r["id"], round(r["score"], 6)) for r in e.recall(0, "thonre tionan", **asked).collect()]
    assert ids(engine) == ids(indexed) == ids(engine.indexed(str(tmp_path / "index"))) and ids(engine) != ids(indexed, kinds=("view",))


def test_only_changed_files_are_chunked(spark, tmp_path, monkeypatch):
    def files(**texts):
        return spark.createDataFrame([(k, v) for k, v in texts.items()], "key string, content string").withColumn("hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))

    index = index_runs.ChunkIndex(spark, str(tmp_path / "index"), 200, 20)
    assert index.chunks() is None and index.state() is None
    index.reindex(files(a="# A\n\nfirst text of a", b="second " * 200, c="", d="going"))
    state = {r["key"]: r for r in index.state().collect()}
    assert state["c"]["status"] == "empty" and state["b"]["chunks"] > 3 and {r["run"] for r in state.values()} == {1}
    seen, chunk = [], index_runs.chunk_documents
    monkeypatch.setattr(index_runs, "chunk_documents", lambda docs, *a: (seen.extend(r["key"] for r in docs.collect()), chunk(docs, *a))[1])
    found = {r["key"]: r["state"] for r in index.reindex(files(a="# A\n\nfirst text of a", b="now short", c="", e="brand new")).collect()}
    assert found == {"a": "same", "b": "changed", "c": "same", "d": "gone", "e": "new"} and sorted(seen) == ["b", "e"]
    assert {r["key"]: r["content"] for r in index.chunks().collect()} == {"a": "first text of a", "b": "now short", "e": "brand new"}

    def broken(*args):
        raise RuntimeError("disk full")

    monkeypatch.setattr(index_runs, "chunk_documents", broken)
    with pytest.raises(RuntimeError):
        index.reindex(files(a="changed again"))
    assert {r["key"] for r in index.chunks().collect()} == {"a", "b", "e"} and index.runs() == [1, 2]
    monkeypatch.setattr(index_runs, "chunk_documents", chunk)
    index.reindex(files(a="changed again"))
    assert [(r["key"], r["content"]) for r in index.chunks().collect()] == [("a", "changed again")] and index.purge() == [1, 2] and index.chunks().count() == 1


def test_chain_from_logs_to_edges(spark, tmp_path):
    root, store = tmp_path / "logs", sync.Versions(spark, str(tmp_path / "store"))
    root.mkdir()
    options = {"names": lambda c: F.regexp_extract_all(c, F.lit(r"(server-\d+)"), F.lit(1)), "least": 2, "threshold": 0.3}

    def write(name, *texts):
        with (root / name).open("a") as f:
            for i, text in enumerate(texts):
                f.write(json.dumps({"type": "user" if i % 2 == 0 else "assistant", "sessionId": name[:-6], "cwd": "/p", "timestamp": f"2026-01-0{1 + i}T00:00:00Z", "message": {"content": text}}, ensure_ascii=False) + "\n")

    def run():
        stream = sync.sync(store, sessions.project_log(jobs.follow_logs(spark, str(root))), str(tmp_path / "check"), **options)
        stream.awaitTermination()
        return store.counters(store.numbers()[-1])

    write("s1.jsonl", "记住：部署到 server-01 之前先备份数据库", "run docker compose up -d server-01 now", "谢谢你的帮助")
    write("s2.jsonl", "必须在 server-01 上使用固定的端口号", "ok then")
    write("s3.jsonl", "记住：一条消息太短所以跳过这个会话")
    first = run()
    assert (first["processed"], first["skipped"], first["merged"]) == (2, 1, 0) and first["created"] + first["pending"] == 3 and first["edges"] > 0
    before = {n: Counter(map(str, t.collect())) for n, t in store.read().items()}
    write("s2.jsonl", "记住：部署到 server-01 之前先备份数据库", "fine", "不要修改 server-02 的防火墙规则设置")
    second = run()
    assert second["merged"] >= 1 and second["processed"] == 1 and store.numbers() == [1, 2]
    tables = store.read()
    things = {r["name"]: r["mentions"] for r in tables["entities"].collect()}
    assert set(things) == {"server-01", "server-02"} and things["server-01"] == 4 and tables["conversations"].filter("session = 's2'").first()["messages"] == 5
    now = {n: Counter(map(str, t.collect())) for n, t in tables.items()}
    # a batch that failed before its commit and is played again writes the same, from the version before it
    shutil.rmtree(tmp_path / "store/version-000000000002/counters")
    assert {n: Counter(map(str, t.collect())) for n, t in store.read().items()} == before
    lines = spark.read.text(str(root / "s2.jsonl")).limit(5)
    numbered = spark.createDataFrame([(str(root / "s2.jsonl"), i * 1000, r["value"]) for i, r in enumerate(lines.collect()) if i >= 2], "path string, at long, line string")
    batch = sessions.project_log(numbered.select("path", F.struct(F.col("at").alias("block"), F.lit(0).cast("long").alias("row")).alias("seq"), "line"))
    assert sync.sync_batch(store, batch, 2, **options) == second == sync.sync_batch(store, batch, 2, **options)
    tables = store.read()
    assert {n: Counter(map(str, t.collect())) for n, t in store.read().items()} == now
    state = delta.State(tables["memories"], tables["vectors"], tables["links"], tables["entities"].select("entity", "mentions"))
    whole = graph.candidates(state.memories, state.vectors, state.links, state.mentions, 0.3)
    key = lambda df: Counter((r["source"], r["target"], r["kind"], round(r["weight"], 6)) for r in df.collect())
    assert key(store.read()["edges"]) == key(whole)
    assert sync.sync_batch(store, batch.limit(0), 3, **options) == dict.fromkeys(sync.COUNTERS, 0)
    assert {n: Counter(map(str, t.collect())) for n, t in store.read().items()} == now
