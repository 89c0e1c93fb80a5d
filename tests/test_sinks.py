import json
import threading

import pytest
from pyspark.sql import functions as F

from idloom.plans.photo_queries import _profile
from idloom.sources import files, sinks
from idloom.sources.sinks import Conflict, VersionedTable

ROW = "k string, v int, seq long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def content(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)
    assert t.version() == 0 and content(t) == []
    assert t.replace(rows(spark, ("a", 1, 0))) == 1 and t.append(rows(spark, ("b", 2, 0), ("b", 2, 0))) == 2
    assert content(t) == [("a", 1, 0), ("b", 2, 0), ("b", 2, 0)] and content(t, 1) == [("a", 1, 0)]
    assert t.keep_latest(rows(spark, ("a", 5, 2), ("a", 4, 1)), ["k"], "seq", "v") == 3 and content(t) == [("a", 5, 2), ("b", 2, 0)]
    assert t.insert_once(rows(spark, ("a", 9, 9), ("c", 3, 1), ("c", 2, 0)), ["k"], ["seq"]) == 4 and content(t) == [("a", 5, 2), ("b", 2, 0), ("c", 2, 0)]
    assert t.compact() == 5 and content(t) == [("a", 5, 2), ("b", 2, 0), ("c", 2, 0)]
    with pytest.raises(Conflict):
        t.replace(rows(spark, ("z", 0, 0)), expected=4)
    assert t.replace(rows(spark, ("z", 0, 0)), expected=5) == 6
    t.vacuum(keep_versions=1)
    assert content(t) == [("z", 0, 0)] and len(t.files.names(f"{t.path}/data")) == 1 and t.version() == 6
    assert content(VersionedTable(spark, f"file://{tmp_path}/t")) == [("z", 0, 0)]
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, f"file://{tmp_path}/none").read()
    assert t.append(rows(spark).limit(0)) == 7 and content(t) == [("z", 0, 0)]


def test_a_reader_between_the_steps_sees_a_whole_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)
    t.replace(rows(spark, ("old", 1, 0)))
    seen = []
    for name in ("_written", "_publish"):
        step = getattr(VersionedTable, name)

        def watched(self, *a, step=step):
            seen.append(content(VersionedTable(spark, self.path)))
            out = step(self, *a)
            seen.append(content(VersionedTable(spark, self.path)))
            return out

        monkeypatch.setattr(VersionedTable, name, watched)
    t.replace(rows(spark, ("new", 2, 0)))
    assert seen == [[("old", 1, 0)]] * 3 + [[("new", 2, 0)]]


def test_a_writer_that_dies_leaves_no_trace_in_the_table(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)
    t.replace(rows(spark, ("old", 1, 0)))
    publish = VersionedTable._publish

    def die(self, *a):
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "_publish", die)
    with pytest.raises(RuntimeError):
        t.append(rows(spark, ("new", 2, 0)), batch=("s", 0))
    monkeypatch.setattr(VersionedTable, "_publish", publish)
    assert content(t) == [("old", 1, 0)] and len(t.files.names(f"{t.path}/data")) == 2
    assert t.append(rows(spark, ("new", 2, 0)), batch=("s", 0)) == 2 and content(t) == [("new", 2, 0), ("old", 1, 0)]
    t.vacuum()
    assert len(t.files.names(f"{t.path}/data")) == 2


def test_the_loser_of_a_race_commits_behind_the_winner(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)
    t.replace(rows(spark, ("a", 1, 0)))
    publish, raced = VersionedTable._publish, []

    def late(self, version, manifest):
        if not raced:
            raced.append(True)
            VersionedTable(spark, self.path).append(rows(spark, ("first", 2, 0)))
        return publish(self, version, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    assert t.append(rows(spark, ("second", 3, 0))) == 3
    assert content(t) == [("a", 1, 0), ("first", 2, 0), ("second", 3, 0)]
    raced.clear()
    assert t.keep_latest(rows(spark, ("a", 7, 7)), ["k"], "seq", "v") == 5  # made anew from what the winner left
    assert content(t) == [("a", 7, 7), ("first", 2, 0), ("second", 3, 0)]


def test_many_writers_at_once(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def work(i):
        try:
            VersionedTable(spark, path, ROW).append(rows(spark, (f"w{i}", i, 0)))
        except Exception as e:  # pragma: no cover
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, path)
    assert not failed and table.version() == 6 and len(content(table)) == 6


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)
    write = t.writer("query")
    for number in (0, 0, 1, 1, 0, 2):
        write(rows(spark, (f"b{number}", number, 0)), number)
    assert content(t) == [("b0", 0, 0), ("b1", 1, 0), ("b2", 2, 0)]
    t.writer("other")(rows(spark, ("o", 9, 0)), 0)
    t.compact()
    write(rows(spark, ("again", 0, 0)), 2)
    assert len(content(t)) == 4


def test_a_stream_whose_commit_log_is_lost_writes_nothing_twice(spark, tmp_path):
    """The last batch of a stream runs again after its acknowledgement is removed."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", ROW)

    def run():
        source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        source.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(t.writer("q")).start().awaitTermination()

    for i in range(3):
        rows(spark, (f"r{i}", i, 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert len(content(t)) == 3 and t.version() == 3
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    run()
    rows(spark, ("r3", 3, 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert content(t) == [(f"r{i}", i, 0) for i in range(4)]


def test_profiles_are_saved_whole_and_checked_when_loaded(spark, tmp_path, monkeypatch):
    good = _profile()
    one = lambda p: spark.createDataFrame([(json.dumps(p),)], "profile string")
    mode = lambda df: json.loads(df.first()["profile"])["mode"]
    path = f"{tmp_path}/profile"
    assert mode(files.load_profile(spark, path, one(good | {"mode": "off"}))) == "off"
    files.save_profile(one(good | {"mode": "observe"}), path)
    move, seen = sinks.Files.move, []

    def watched(self, *a, **k):
        seen.append(mode(spark.read.parquet(path)))
        out = move(self, *a, **k)
        seen.append(mode(spark.read.parquet(path)))
        return out

    monkeypatch.setattr(sinks.Files, "move", watched)
    files.save_profile(one(good | {"mode": "enforce"}), path)
    assert seen == ["observe", "enforce"] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["profile"]
    assert mode(files.load_profile(spark, path, one(good))) == "enforce"
    sinks.save_file(one(good | {"mode": "maybe"}), path)
    with pytest.raises(ValueError, match="mode"):
        files.load_profile(spark, path, one(good))
    one(good).write.parquet(f"{tmp_path}/old")  # a folder, as profiles were saved before
    files.save_profile(one(good | {"mode": "enforce"}), f"{tmp_path}/old")
    assert mode(files.load_profile(spark, f"{tmp_path}/old", one(good))) == "enforce"


def test_replaced_tables_keep_their_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert [files.replace_table(rows(spark, ("a", i, 0)), path) for i in range(2)] == [1, 2]
    assert VersionedTable(spark, path).read().select(F.max("v")).first()[0] == 1
