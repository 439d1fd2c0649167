from __future__ import annotations

import json

from pyspark.sql import functions as F

from skein.functions import dispatch
from skein.sources import runs


def test_run_logs(spark, tmp_path):
    lines = [
        {"type": "assistant", "message": {"id": "m1", "content": [{"type": "tool_use", "name": "Read", "id": "t1"}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
        {"type": "assistant", "message": {"id": "m1", "content": [{"type": "tool_use", "name": "Grep", "id": "t2"}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "abc"}]}},
        {"type": "result", "subtype": "success", "duration_ms": 9, "total_cost_usd": 0.5, "num_turns": 2},
    ]
    (tmp_path / "with-1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (tmp_path / "without-1.jsonl").write_text(json.dumps(lines[3]) + "\n")
    m = {r.run: r for r in runs.metrics(runs.read(spark, str(tmp_path))).collect()}
    r = m["with-1"]
    assert (r.calls, r.reads, r.searches, r.chars, r.input, r.output, r.ok) == (2, 1, 1, 3, 5, 2, True) and m["without-1"].calls == 0
    arms = runs.report(runs.metrics(runs.read(spark, str(tmp_path))), lambda run: F.regexp_extract(run, "^(with(?:out)?)", 1))
    assert {r.arm: r.calls for r in arms.collect()} == {"with": 2, "without": 0}


def test_dispatch(spark):
    bodies = spark.createDataFrame([("a", "python", "getattr(x, 'run')(); bus.emit('done')"), ("b", "go", "getattr(x, 'run')"), ("c", "ruby", "x.send(:go); y.send(:a); z.send(:b); w.send(:c)")], "id string, language string, body string")
    out = sorted(tuple(r) for r in dispatch.scan(bodies).collect())
    assert out == [("a", "event-emit", "done"), ("a", "getattr", "run"), ("c", "send", "a"), ("c", "send", "b"), ("c", "send", "go")]
