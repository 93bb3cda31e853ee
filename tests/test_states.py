import time

from scholarlake.streaming import states


def test_job_states_survive_a_restart_and_repetitions(spark, tmp_path):
    def go(name, rows, **k):
        spark.createDataFrame(rows, states.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        states.follow(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), kept=3, **k).awaitTermination()
        return {r.job_id: (r.status, r.last, r.illegal, r.kept, r.oldest) for r in states.current(spark, str(tmp_path / "out")).collect()}

    first = [("a", "running", "too early", 1), ("a", "queued", "x", 2), ("a", None, "line", 3), ("b", "queued", None, 4), (None, "queued", "nobody", 5), ("w", "queued", None, 6), ("w", "deferred", None, 7)]
    assert go("0", first[::-1], retry_ms=1) == {"a": ("queued", 2, 1, 3, 1), "b": ("queued", 4, 0, 0, -1), "w": ("deferred", 7, 0, 0, -1)}
    time.sleep(0.1)
    second = [("a", "queued", "x", 2), ("a", "running", "y", 8), ("a", "done", "z", 9), ("a", "error", "after the end", 10), ("b", "cancelled", None, 11)]
    got = go("1", second, retry_ms=1)
    assert got["a"] == ("done", 9, 2, 3, 8) and got["b"] == ("cancelled", 11, 0, 0, -1)
    assert got["w"] == ("queued", 7, 0, 0, -1)
