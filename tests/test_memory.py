"""Attempts, exclusions, streaks and rules, on fixtures and against a plain-Python twin; batch equals stream."""

import random

from pyspark.sql import functions as F

from pagetrail.operators import memory as M
from pagetrail.streaming.memory_stream import remember

SCHEMA = "run_id long, step int, operation string, kind string, action string, text string, url_before string, url string, page_changed boolean, role string, tool_ok boolean"


def frame(spark, rows):
    base = dict.fromkeys((c.split()[0] for c in SCHEMA.split(", ")))
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SCHEMA)


def act(step, action="Go", op="CLICK", run=1, **more):
    return {"run_id": run, "step": step, "operation": op, "kind": "click", "action": action, "url_before": "https://a.test/p#x", "url": "https://a.test/p#x", "page_changed": True, "role": "button", **more}


def test_outcomes_and_failures(spark):
    rows = [
        act(0, url="https://a.test/q"), act(1, page_changed=False), act(2, page_changed=None), act(3, op="TYPE_TEXT", page_changed=False),
        act(4, role="searchbox", page_changed=False), act(5, url_before=None, page_changed=False, url="https://b.test/#y"), act(6, op=None, kind="wait", page_changed=False),
        act(7, op="GOTO", tool_ok=True, page_changed=False), act(8, op="GOTO", tool_ok=False, url="https://c.test/"), act(9, url=None),
    ]
    got = {r.step: r for r in M.attempts(frame(spark, rows)).collect()}
    assert [got[i].outcome for i in range(10)] == ["url_changed", "no_change", "no_change", "no_change", "no_change", "no_change", "no_change", "no_change", "url_changed", "url_changed"]
    assert [got[i].failed for i in range(10)] == [False, True, True, False, False, True, True, False, True, False]
    assert [got[i].completed for i in range(10)] == [True, False, False, True, True, False, False, False, False, True]
    assert got[0].url == "https://a.test/p" and got[5].url == "https://b.test/" and got[6].operation == "WAIT"


def test_exclusions(spark):
    rows = [
        act(0, "Open Ménu!"), act(1, "open menu"), act(2, "Buy", page_changed=False), act(3, "BUY"), act(4, "Once"), act(5, "Buy", url_before="https://a.test/other"),
    ]
    got = {(r.url, r.label): (r.display, r.reason) for r in M.exclusions(M.attempts(frame(spark, rows))).collect()}
    assert got == {("https://a.test/p", "open menu"): ("Open Ménu!", "repeated"), ("https://a.test/p", "buy"): ("Buy", "no effect")}


def test_block_and_stall(spark):
    rows = [act(i, page_changed=False) for i in range(3)] + [act(i, run=2, page_changed=False if i != 1 else None) for i in range(3)] + [act(i, run=3, page_changed=False, kind="wait") for i in range(3)]
    assert [(r.run_id, r.step) for r in M.blocked(frame(spark, rows)).where("blocked").collect()] == [(1, 2)]
    rows = [act(i, f"b{i}", page_changed=False) for i in range(5)] + [act(i, run=2, page_changed=i == 1) for i in range(5)]
    got = M.stalled(M.streaks(M.attempts(frame(spark, rows)))).where("stalled").orderBy("run_id", "step").collect()
    assert [(r.run_id, r.step) for r in got] == [(1, 3), (1, 4)]


def twin(rows):
    """(run, step) -> streak, done, times tried, reason, written from the rules."""
    out, runs = {}, {}
    for r in sorted(rows, key=lambda r: (r["run_id"], r["step"])):
        s = runs.setdefault(r["run_id"], {"streak": 0, "done": 0, "n": {}, "f": set()})
        url = (r["url_before"] or r["url"] or "").split("#")[0]
        moved = r["url_before"] is not None and r["url"] != r["url_before"]
        still = not moved and not r["page_changed"]
        failed = (not r["tool_ok"]) if r["tool_ok"] is not None else still and r["operation"] != "TYPE_TEXT" and not (r["operation"] == "CLICK" and r["role"] in ("textbox", "searchbox"))
        done = not failed and (r["tool_ok"] is None or not still)
        s["streak"] = 0 if moved else s["streak"] + 1
        s["done"] += done
        key = (url, r["operation"], r["action"].lower())
        s["n"][key] = s["n"].get(key, 0) + 1
        if failed:
            s["f"].add(key)
        out[r["run_id"], r["step"]] = (s["streak"], s["done"], s["n"][key], "no effect" if key in s["f"] else "repeated" if s["n"][key] > 1 else None)
    return out


def history(seed=3):
    rng = random.Random(seed)
    urls = ["https://a.test/", "https://a.test/#f", "https://b.test/"]
    return [
        act(i, rng.choice(["Go", "go", "Buy"]), rng.choice(["CLICK", "TYPE_TEXT", "GOTO"]), run, url_before=rng.choice([*urls, None]), url=rng.choice(urls),
            page_changed=rng.choice([True, False, None]), role=rng.choice(["button", "searchbox", None]) or "", tool_ok=rng.choice([None, None, True, False]))
        for run in range(6) for i in range(20)
    ]


def test_batch_twin(spark):
    rows = history()
    want = twin(rows)
    got = {(r.run_id, r.step): (r.streak, r.done) for r in M.streaks(M.attempts(frame(spark, rows))).collect()}
    assert got == {k: v[:2] for k, v in want.items()}


def test_stream_twin_and_replay(spark, tmp_path):
    rows = history(5)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = frame(spark, rows)
    df.where("step < 8").coalesce(1).write.json(src)
    def run():
        stream = remember(spark.readStream.schema(SCHEMA).json(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    df.where("step < 12").coalesce(1).write.mode("append").json(src)  # steps below 8 are delivered again
    run()
    df.where("step >= 12").coalesce(1).write.mode("append").json(src)
    run()
    got = {(r.run_id, r.step): (r.streak, r.done, r.times, r.excluded) for r in spark.read.parquet(out).collect()}
    assert got == twin(rows) and spark.read.parquet(out).count() == len(rows)


def test_budget_and_usable(spark):
    rows = [act(i, f"x{i}") for i in range(5)]
    assert M.within_budget(frame(spark, rows), 2).count() == 2
    tried = M.attempts(frame(spark, [act(0, "a", page_changed=False), act(1, "b")]))
    left = M.usable(tried.select("run_id", "url", "operation", "label"), M.exclusions(tried)).collect()
    assert [r.label for r in left] == ["b"]
    assert M.exclusions(tried.where(F.lit(False))).count() == 0
