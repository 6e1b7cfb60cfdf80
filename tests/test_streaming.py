import json

from leafwright.streaming.events import numbered, read_events, valid, windowed_latency


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def event(run, i, minute, kind="delta", value=1.0):
    return {"run_id": run, "event_id": i, "ts": f"2024-01-01T00:{minute:02d}:00Z", "kind": kind, "value": value}


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_numbers_go_on_over_batches(spark, tmp_path):
    write(tmp_path, "1.json", [event("a", 1, 0), event("b", 2, 0), event("a", 3, 1)])
    write(tmp_path, "2.json", [event("a", 4, 2), event("b", 5, 2), event("b", 6, 3, kind="nonsense"), event("a", 3, 1), event("b", 2, 0)])
    rows = run(spark, numbered(valid(read_events(spark, str(tmp_path)))), "seqs")
    by = {}
    for r in rows:
        by.setdefault(r.run_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in by.items()} == {"a": [1, 2, 3], "b": [1, 2]}


def test_windows(spark, tmp_path):
    write(tmp_path, "1.json", [event("a", i, i, value=float(i)) for i in range(5)])
    rows = run(spark, windowed_latency(read_events(spark, str(tmp_path))), "slas", "complete")
    full = [r for r in rows if r.n == 5]
    assert len(full) == 1 and round(full[0].p95, 4) == 3.8
