"""The tailing source and the appending sink, most of it without a stream."""

import os

import pytest
from pyspark.sql import functions as F

from palisade.sources import tail


def reader(folder, **options):
    return tail.TailReader({"path": str(folder), **{k: str(v) for k, v in options.items()}})


def lines(source, start, end):
    out = []
    for part in source.partitions(start, end):
        for batch in source.read(part):
            out += [(r["file"], r["at"], r["line"]) for r in batch.to_pylist()]
    return out


def texts(source, start, end):
    return [line for _, _, line in lines(source, start, end)]


def test_starts_at_the_end_and_waits_for_whole_lines(tmp_path):
    log = tmp_path / "os.log"
    log.write_text("head\nold\n")
    source = reader(tmp_path)
    start = source.initialOffset()
    with log.open("a") as f:
        f.write("new one\npart")
    middle = source.latestOffset()
    assert lines(source, start, middle) == [("os.log", 9, "new one")]
    with log.open("ab") as f:
        f.write(b" of a line\n\n\xff caf\xc3\xa9\n")
    assert texts(source, middle, source.latestOffset()) == ["part of a line", "", " café"]


def test_renamed_and_new_files(tmp_path):
    log = tmp_path / "app.log"
    log.write_text("first file\n")
    source = reader(tmp_path)
    start = source.initialOffset()
    with log.open("a") as f:
        f.write("before\n")
    log.rename(tmp_path / "app.log.1")
    log.write_text("second file\nafter\n")
    middle = source.latestOffset()
    assert sorted(texts(source, start, middle)) == ["after", "before", "second file"]
    with (tmp_path / "app.log.1").open("a") as f:
        f.write("late\n")
    end = source.latestOffset()
    planned = source.partitions(middle, end)
    (tmp_path / "app.log.1").rename(tmp_path / "app.log.2")  # between planning and reading
    found = [r["line"] for p in planned for b in source.read(p) for r in b.to_pylist()]
    assert found == ["late"]


def test_truncated_file_starts_again(tmp_path):
    log = tmp_path / "os.log"
    log.write_text("one\ntwo\n")
    source = reader(tmp_path)
    start = source.initialOffset()
    log.write_text("three\n")
    assert texts(source, start, source.latestOffset()) == ["three"]


def test_every_line_in_one_range(tmp_path, monkeypatch):
    body = [f"{k} " + "x" * (k * 7 % 40) for k in range(200)] + ["y" * 300, "", "end"]
    (tmp_path / "network.log").write_text("\n".join(body) + "\n")
    source = reader(tmp_path, **{"from": "start"})
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(tail, "SPLIT_BYTES", size)
        monkeypatch.setattr(tail, "STEP_BYTES", max(1, size // 2))
        got = lines(source, {}, source.latestOffset())
        assert [t for _, _, t in got] == body
        whole = "\n".join(body) + "\n"
        assert all(whole[at:at + len(t)] == t for _, at, t in got)


def test_files_that_begin_alike(tmp_path):
    (tmp_path / "a.log").write_text("same\n")
    os.link(tmp_path / "a.log", tmp_path / "b.log")
    with pytest.raises(ValueError, match="begin alike"):
        reader(tmp_path).latestOffset()


def test_lost_growth_is_an_error(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    source = reader(tmp_path, **{"from": "start"})
    end = source.latestOffset()
    log.rename(tmp_path.parent / f"{tmp_path.name}-gone.log")
    with pytest.raises(FileNotFoundError):
        source.partitions({}, end)


def test_batches_of_frames(tmp_path):
    """Multiples of 30 up to the limit; the rest only when time is up; the place is kept."""
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    options = {"from": "start", "frames": 30, "most": 60, "seconds": 3600, "state": state}
    (folder / "0.log").write_text("".join(f"a{k}\n" for k in range(50)))
    (folder / "1.log").write_text("".join(f"b{k}\n" for k in range(55)))
    source = reader(folder, **options)
    offsets = [source.initialOffset()]
    for _ in range(3):
        offsets.append(source.latestOffset())
        offsets[-1] == offsets[-2] or source.partitions(offsets[-2], offsets[-1])
    got = [texts(reader(folder, **{"from": "start"}), a, b) for a, b in zip(offsets, offsets[1:])]
    assert [len(x) for x in got] == [60, 30, 0]  # 15 lines wait
    again = reader(folder, **{**options, "seconds": 0})
    last = again.latestOffset()
    assert len(texts(again, offsets[-1], last)) == 15
    assert sum(got, []) + texts(again, offsets[-1], last) == [
        f"a{k}" for k in range(50)] + [f"b{k}" for k in range(55)]


def test_sink_adds_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    writer = tail.LogWriter(path, ["a", "b"])
    for _ in range(3):
        writer.commit([writer.write(iter([(1, "x"), (2, "é")])), writer.write(iter([]))], 0)
    writer.commit([writer.write(iter([(3, None)])), None], 1)
    rows = tail.read_log(spark, path, "a long, b string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, "é"), (3, None)]
    assert not os.listdir(f"{path}/_staged")


def test_sink_after_a_broken_commit(spark, tmp_path):
    """Files moved without a commit record are not read, and the batch comes in whole later."""
    path = str(tmp_path / "log")
    writer = tail.LogWriter(path, ["a"])
    os.makedirs(f"{path}/lines")
    for k in range(3):
        with open(f"{path}/lines/{0:010d}-{k:06d}.json", "w") as f:
            f.write('{"a": 99}\n')
    assert tail.read_log(spark, path, "a long").collect() == []
    writer.commit([writer.write(iter([(1,)]))], 0)
    assert [r.a for r in tail.read_log(spark, path, "a long").collect()] == [1]
    staged = writer.write(iter([(7,)]))
    writer.abort([staged, None], 1)
    assert not os.path.exists(staged.path)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log, path, mark = folder / "os.log", str(tmp_path / "log"), str(tmp_path / "mark")
    log.write_text("start\n")
    schema = "line string"
    for k in range(2):
        run = tail.append(tail.tail(spark, str(folder)).select("line"), path, mark)
        run.processAllAvailable()
        with log.open("a") as f:
            f.write(f"now {k}\n")
        run.processAllAvailable()
        run.stop()
        with log.open("a") as f:
            f.write(f"between {k}\n")
    rows = tail.read_log(spark, path, schema).orderBy(F.desc("line")).collect()
    assert [r.line for r in rows] == ["now 1", "now 0", "between 0"]
