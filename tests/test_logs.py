"""Growing logs: half lines, truncation, rotation, ranges of bytes, and a stream across restarts."""

import os
import random

from mnemotide.sources.logs import LogStream, follow


def _tick(reader, start):
    end = reader.latestOffset()
    return [row for p in reader.partitions(start, end) for row in reader.read(p)], end


def test_each_line_once_as_files_grow(tmp_path):
    rng = random.Random(4)
    for split in (1, 7, 1 << 20):
        folder = tmp_path / f"s{split}"
        folder.mkdir()
        text = b"".join(("é😀 line %d " % i * rng.randrange(4)).encode() + b"\n" for i in range(60)) + b"\r\n\n" + b"x" * 200 + b"\nlast half"
        reader, start, got, at = LogStream(str(folder), ".log", split), {}, [], 0
        while at < len(text):
            step = rng.randrange(1, 90)
            with open(folder / "a.log", "ab") as f:
                f.write(text[at : at + step])
            at += step
            rows, start = _tick(reader, start)
            got += rows
        assert [r[2] for r in got] == text.decode().replace("\r", "").split("\n")[:-1]
        assert all(text[r[1] :].decode().replace("\r", "").startswith(r[2]) for r in got)


def test_cut_replaced_and_lost_files(tmp_path):
    reader, log = LogStream(str(tmp_path), "", 1 << 20), tmp_path / "a"
    (tmp_path / "_hidden").write_text("no\n")
    assert _tick(reader, {}) == ([], {})
    log.write_text("one")
    rows, start = _tick(reader, {})
    assert rows == []
    log.write_text("one\ntwo\n")
    rows, start = _tick(reader, start)
    assert [r[2] for r in rows] == ["one", "two"] and _tick(reader, start)[0] == []
    log.write_text("one\n")  # cut: what is left is new
    rows, start = _tick(reader, start)
    assert [r[2] for r in rows] == ["one"]
    os.replace(log, tmp_path / "a.1")
    log.write_text("another first line\nmore\n")  # rotated: the old file has another name now
    rows, start = _tick(reader, start)
    assert [(r[0].rsplit("/", 1)[1], r[2]) for r in rows] == [("a", "another first line"), ("a", "more"), ("a.1", "one")]
    log.unlink()
    assert _tick(reader, start)[0] == []


def _run(spark, folder, out, state):
    stream = follow(spark, str(folder), ".jsonl", split=16)
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination(120)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    want = []
    for n in range(3):
        with open(folder / "a.jsonl", "a") as f:
            f.write(f"line {n} one\nline {n} two\nhalf {n} ")
        if n == 1:
            (folder / "b.jsonl").write_text("other\n")
            want.append("other")
        want += [f"half {n - 1} line {n} one" if n else "line 0 one", f"line {n} two"]
        _run(spark, folder, out, state)
        got = spark.read.parquet(str(out))
        assert sorted(r.line for r in got.collect()) == sorted(want)
    assert got.select("file", "offset").distinct().count() == len(want)
