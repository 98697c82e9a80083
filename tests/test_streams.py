import datetime as dt
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from codeweft.api import Engine
from codeweft.operators import text
from codeweft.streaming import watcher
from codeweft.streaming.traces import job_states, next_interval


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()

    def run(*words):
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q")
    (root / "a.py").write_text("def first():\n    return 1\n")
    (root / "b c.py").write_text("def other():\n    return first()\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    return root, run


def test_two_commits_are_two_batches(spark, tree, tmp_path):
    root, run = tree
    seen = []
    changes = watcher.tree_changes(spark, str(root), base_ms=1)
    query = changes.writeStream.foreachBatch(lambda rows, n: seen.append(sorted((r["path"], r["deleted"]) for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="50 milliseconds").start()
    try:
        told = lambda: [b for b in seen if b]

        def until(n):
            for _ in range(300):
                query.processAllAvailable()
                if len(told()) >= n:
                    return
                assert query.exception() is None
            raise AssertionError(seen)

        query.processAllAvailable()
        (root / "a.py").write_text("def second():\n    return 1\n")
        run("commit", "-qam", "two")
        until(1)
        run("rm", "-q", "b c.py")
        run("commit", "-qm", "three")
        until(2)
        paths = [p for b in told() for p in b]
        assert ("b c.py", True) in paths and ("a.py", False) in paths and ("b c.py", True) not in told()[0]
    finally:
        query.stop()


def test_states_of_a_tree(tree):
    root, run = tree
    old = watcher.tree_state(str(root))
    assert old["files"] == {} and old["head"] == run("rev-parse", "HEAD")
    (root / "a.py").write_text("x = 1\n")
    (root / "sub").mkdir()
    (root / "sub" / "é new.py").write_text("y = 1\n")
    edited = watcher.tree_state(str(root))
    assert watcher.between(str(root), old, edited) == ["a.py", "sub/é new.py"] and watcher.between(str(root), edited, edited) == []
    os.utime(root / "a.py", (5, 5))
    assert watcher.between(str(root), edited, watcher.tree_state(str(root))) == ["a.py"]
    run("checkout", "-q", "a.py")
    back = watcher.tree_state(str(root))
    assert watcher.between(str(root), edited, back) == ["a.py"], "an edit that is taken back is a change too"
    run("add", "-A")
    run("commit", "-qm", "two")
    assert watcher.between(str(root), back, watcher.tree_state(str(root))) == ["sub/é new.py"]
    assert watcher.between(str(root), {"head": "", "files": {}}, watcher.tree_state(str(root))) == ["a.py", "b c.py", "sub/é new.py"]
    assert watcher.tree_state(str(root / "none")) is None


def test_looks_are_spaced(tree, monkeypatch):
    root, run = tree
    clock, looks = [0.0], []
    real = watcher.tree_state
    monkeypatch.setattr(watcher.time, "monotonic", lambda: clock[0])
    monkeypatch.setattr(watcher, "tree_state", lambda r: looks.append(clock[0]) or real(r))
    (root / "a.py").write_text("x = 1\n")
    reader = watcher._TreeReader({"path": str(root), "since": ""})
    for k in range(0, 400):
        clock[0] = k
        reader.latestOffset()
    assert looks == [0, 5, 15, 35, 75, 135, 195, 255, 315, 375] and next_interval(60_000, True, False) == 5_000


def test_watch_keeps_a_project_up_to_date(spark, tree, tmp_path):
    root, run = tree
    engine, again = Engine(spark, str(tmp_path / "store")), Engine(spark, str(tmp_path / "other"))
    engine.index_repository(str(root), project="p")
    look = lambda: engine.watch(str(root), str(tmp_path / "c"), "p", once=True, base_ms=1).awaitTermination()
    names = lambda e: sorted(r["qualified_name"] for r in e.store("p").read("symbols").collect())
    look()
    (root / "a.py").write_text("def second():\n    return 1\n")
    (root / "new.py").write_text("def third():\n    return second()\n")
    look()
    assert any("second" in n for n in names(engine)) and any("third" in n for n in names(engine)) and not any("first" in n for n in names(engine))
    run("checkout", "-q", "a.py")
    os.remove(root / "new.py")
    run("rm", "-q", "b c.py")
    run("commit", "-qm", "two")
    look()
    again.index_repository(str(root), project="p")
    assert names(engine) == names(again) and any("first" in n for n in names(engine)) and not any("other" in n for n in names(engine))


def _stream(spark, folder, batches, schema, make, checkpoint):
    """What the last row of each key says after all batches."""
    pytest.importorskip("google.protobuf")
    from codeweft.streaming.states import start_stateful

    os.makedirs(folder)
    got = {}

    def batch(rows, n):
        for r in rows.collect():
            got[r[0], r[1]] = r.asDict()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, rows in enumerate(batches):
        with open(os.path.join(folder, f"{k}.json"), "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        start_stateful(spark, make(spark.readStream.schema(schema).json(folder)).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return got


def test_job_stream_is_the_batch_version(spark, tmp_path):
    from codeweft.streaming.states import job_changes

    rng, log, t = random.Random(4), [], 0
    for job in range(30):
        for state in rng.choice([["Queued", "Running", "Completed"], ["Queued", "Failed"], ["Queued", "Running"], ["Running", "Completed"], ["Queued", "Completed", "Running", "Failed", "Running"], ["Queued", "nonsense"], ["Running", "Queued", "Running"]]):
            t += 1
            log.append({"project": f"p{job % 2}", "job": f"j{job:02}", "state": state, "at": (dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t)).isoformat()})
    log.append({"project": "p0", "job": None, "state": "Queued", "at": "2026-01-02T00:00:00"})
    schema = "project string, job string, state string, at timestamp"
    got = _stream(spark, str(tmp_path / "in"), [log[:20], log[20:55], log[55:]], schema, lambda s: job_changes(s, 4), str(tmp_path / "c"))
    want = {(r["project"], r["job"]): (r["state"], r["at"]) for r in job_states(spark.read.schema(schema).json(str(tmp_path / "in")), 4).collect()}
    assert {k: (r["state"], r["at"]) for k, r in got.items() if r["kept"]} == want and any(not r["kept"] for r in got.values())


def test_session_stream_expires_as_the_batch_version(spark, tmp_path):
    from codeweft.streaming.states import session_changes

    rng = random.Random(6)
    at = lambda s: (dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    rows = [{"project": f"p{k % 2}", "session": f"s{k:02}", "created_at": at(k * 60 + rng.randint(0, 30))} for k in range(40)]
    rows.append({"project": "p0", "session": None, "created_at": at(0)})
    schema = "project string, session string, created_at timestamp"
    got = _stream(spark, str(tmp_path / "in"), [rows[:10], rows[10:30], rows[30:]], schema, lambda s: session_changes(s, ttl_seconds=900, newest=6), str(tmp_path / "c"))
    kept = {k for k, r in got.items() if r["kept"]}
    whole = spark.read.schema(schema).json(str(tmp_path / "in")).where("session is not null")
    now = whole.agg(F.max("created_at")).first()[0]
    for p in ("p0", "p1"):
        want = {(p, r["session"]) for r in text.retained(whole.where(F.col("project") == p), F.lit(now), 900, 6).collect()}
        assert {k for k in kept if k[0] == p} == want
