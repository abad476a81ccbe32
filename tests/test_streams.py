"""Lines by byte ranges, as a batch and as a stream, and sessions as keyed state."""

import json
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import growing, incremental, sessions
from lorekeep.streaming import jobs, registry


def said(text, session="s1", at="2026-01-01T00:00:00Z", **more):
    return json.dumps({"type": "user", "sessionId": session, "timestamp": at, "message": {"content": text}, **more}, ensure_ascii=False)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_every_line_once(tmp_path, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abü\U0001f600") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(60)]
    path = tmp_path / "a b%20.jsonl"
    path.write_bytes("".join(x + "\n" for x in lines).encode() + b"torn")
    size = path.stat().st_size
    cuts = sorted({0, size, *(rng.randrange(size) for _ in range(25))})
    found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in growing.lines_between(str(path), 0, a, b)]
    assert [x[2] for x in found] == lines and [x[0] for x in found[1:]] == [x[1] for x in found[:-1]]
    assert [x[2] for x in growing.lines_between(path.as_uri(), 0, 0, size, tail=True)] == lines
    path.write_bytes(b'x\n{"a": 1}')
    assert [x[2] for x in growing.lines_between(str(path), 2, 2, 10, tail=True)] == ['{"a": 1}']


def test_cursors_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    root.mkdir()
    log = root / "one.jsonl"

    def read(cursors):
        new, after = incremental.resume(spark, str(root), cursors)
        return [json.loads(r["line"])["message"]["content"] if r["line"].startswith("{") else r["line"] for r in new.orderBy("start").collect()], after

    log.write_text(said("one") + "\n")
    stamp = log.stat().st_mtime
    got, cursors = read(incremental.no_cursors(spark))
    assert got == ["one"]
    with log.open("a") as f:
        f.write(said("two") + "\nno json at all\n" + said("three") + "\n")
    os.utime(log, (stamp, stamp))  # within the same modification time
    got, cursors = read(cursors)
    assert got == ["two", "no json at all", "three"]
    listed = incremental.changed

    def grown(*args):  # the file grows between listing and reading
        rows = incremental.stored(listed(*args), "listed")
        rows.count()
        with log.open("a") as f:
            f.write(said("five") + "\n")
        return rows

    with log.open("a") as f:
        f.write(said("four") + "\n")
    monkeypatch.setattr(incremental, "changed", grown)
    got, cursors = read(cursors)
    monkeypatch.setattr(incremental, "changed", listed)
    assert got == ["four"]
    got, cursors = read(cursors)
    assert got == ["five"] and read(cursors)[0] == []
    bad = sessions.corrupt(incremental.resume(spark, str(root), incremental.no_cursors(spark))[0])
    assert [r["line"] for r in bad.collect()] == ["no json at all"]


def test_stream_reads_appended_bytes_only(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    (root / "deep").mkdir(parents=True)

    def run():
        """Restarts the stream from its checkpoint and returns all lines that it has ever given."""
        lines = growing.growing_lines(spark, str(root))
        lines.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(str(out)).awaitTermination()
        return Counter(r["line"] for r in spark.read.schema(growing.SCHEMA).parquet(str(out)).collect())

    (root / "a.jsonl").write_text("one\ntwo\nto")
    (root / "deep/b.jsonl").write_text("bee\n")
    (root / "c.txt").write_text("no\n")
    assert run() == Counter(["one", "two", "bee"])
    stamp = (root / "a.jsonl").stat().st_mtime
    with (root / "a.jsonl").open("a") as f:
        f.write("rn\nbroken {\n\nfour\n")
    os.utime(root / "a.jsonl", (stamp, stamp))
    assert run() == Counter(["one", "two", "bee", "torn", "broken {", "four"]) and run() == Counter(["one", "two", "bee", "torn", "broken {", "four"])
    (root / "deep/b.jsonl").write_text("b2\n")  # truncated
    (root / "deep/d.jsonl").write_text("dee\n")
    assert run() == Counter(["one", "two", "bee", "torn", "broken {", "four", "b2", "dee"])


def test_sessions_as_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", registry.PROVIDER)
    root = tmp_path / "logs"
    root.mkdir()
    seen = []

    def keep(batch, epoch):
        seen.extend(r.asDict() for r in batch.collect())

    def wait(done):
        until = time.time() + 60
        while not done() and time.time() < until:
            time.sleep(0.3)
        assert done(), seen

    def write(*lines):
        with (root / "one.jsonl").open("a") as f:
            f.writelines(x + "\n" for x in lines)

    try:
        messages = sessions.project_log(jobs.follow_logs(spark, str(root)))
        named = messages.withColumn("names", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
        states = registry.session_states(named, "1500 milliseconds")
        write(said("first of Anna", cwd="/a", gitBranch="main"), said("Bob and Anna", at="2026-01-01T00:01:00Z"), said("other", "s2"))
        stream = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start()
        try:
            wait(lambda: {(r["session"], r["status"]) for r in seen} >= {("s1", "settled"), ("s2", "settled")})
            write(said("again Anna", at="2026-01-02T00:00:00Z", cwd="/b"))
            wait(lambda: any(r["reopened"] == 1 and r["status"] == "settled" for r in seen))
        finally:
            stream.stop()
        last = {r["session"]: r for r in seen}
        first = next(r for r in seen if r["session"] == "s1")
        assert (first["status"], first["messages"], first["reopened"], first["mentions"]) == ("open", 2, 0, {"Anna": 2, "Bob": 1})
        assert last["s1"]["mentions"] == {"Anna": 3, "Bob": 1} and (last["s2"]["messages"], last["s2"]["mentions"]) == (1, {})
        lines, _ = incremental.resume(spark, str(root), incremental.no_cursors(spark))
        for r in sessions.sessions_of(sessions.project_log(lines)).collect():  # the same as a batch over all files
            assert all(last[r["session"]][c] == r[c] for c in ("messages", "started", "ended", "title", "cwd", "branch", "model")), (r, last[r["session"]])
        assert sum(r["session"] == "s2" for r in seen) == 2  # an untouched session is not told again
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
