"""Run logs, locks, search settings and the demonstration table."""

import pytest

from spindrift.functions import text as T
from spindrift.operators import embed, knn
from spindrift.sources import demo, runs


def test_events_survive_a_torn_line(tmp_path):
    r = runs.Run(tmp_path)
    assert [r.emit("start"), r.emit("batch", rows=3)] == [1, 2]
    with r.path.open("a") as f:
        f.write('{"id": 3, "ki')
    assert [e["kind"] for e in r.after(1)] == ["batch"] and len(runs.Run(tmp_path, r.run_id).after(0)) == 2


def test_locks(tmp_path):
    with runs.locked(tmp_path / "l"):
        with pytest.raises(runs.Busy), runs.locked(tmp_path / "l"):
            pass
    (tmp_path / "l").write_text("999999999")
    with runs.locked(tmp_path / "l"):
        pass
    assert not (tmp_path / "l").exists()


def test_sweep():
    assert knn.sweep(40, [10, 80]) == [10, 40, 80] and knn.sweep(40, [10, 40], 3) == [40, 10]


def test_demo(spark):
    df = demo.articles(spark, 60)
    assert df.select(T.script("text").alias("s")).distinct().count() == 2 and df.select("text").distinct().count() == 60
    assert embed.hash_md5(df, 32).count() == 60
