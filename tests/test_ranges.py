import os
import random

import pytest
from loamworks.sources import ranges as R


def put(path, data, when=None, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(data)
    if when:
        os.utime(path, (when, when))


def lines(df):
    return [r.line for r in sorted(df.collect(), key=lambda r: (r.path, r.place))]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_each_line_is_in_one_range(tmp_path, size):
    rnd = random.Random(size)
    data = b"".join(rnd.choice([b"", b"x", b"word " * 9, "é漢".encode(), b"cr\r"]) + b"\n" for _ in range(60))
    put(tmp_path / "a.jsonl", data)
    with open(tmp_path / "a.jsonl", "rb") as f:
        found = [x for part in R.ranges_of("a", 0, len(data), size) for x in R.lines_of(f, part, [0])]
    assert [x for _, x in found] == [x.removesuffix(b"\r") for x in data.split(b"\n")[:-1]]
    assert all(data[at - 1 : at] in (b"", b"\n") for at, _ in found)


def test_grown_replaced_and_half_written_files(spark, tmp_path):
    root, index = tmp_path / "logs", str(tmp_path / "index")
    a, b, c = root / "a.jsonl", root / "deep" / "b.jsonl", root / "c.jsonl"
    put(a, b"a1\na2\n", 1000)
    put(b, b"b1\nb2\nhalf", 1000)
    put(c, b"c1\n" * 5, 1000)
    put(root / "subagents" / "x.jsonl", b"never\n")
    put(root / "deep" / "SubAgents" / "y.jsonl", b"never\n")
    put(root / "note.txt", b"never\n")
    os.symlink(a, root / "link.jsonl")
    first = R.begin(spark, str(root), index)
    assert lines(first.lines) == ["a1", "a2", *["c1"] * 5, "b1", "b2"]
    again = R.begin(spark, str(root), index)  # nothing was committed: the same once more
    assert again.steps == first.steps
    again.commit()
    none = R.begin(spark, str(root), index)
    assert none.steps == [] and lines(none.lines) == []
    put(a, b"a3\n", 1010, "ab")  # grown
    put(b, b" and more\n", 1010, "ab")  # the half line ends
    put(c, b"c2\n" * 5, 1010)  # of the same size, another time
    grown = R.begin(spark, str(root), index, range_bytes=4)
    assert lines(grown.lines) == ["a3", *["c2"] * 5, "half and more"]
    read = {r.path: r.bytes_read for r in grown.report.groupBy("path").sum("bytes_read").withColumnRenamed("sum(bytes_read)", "bytes_read").collect()}
    assert read[str(a)] == 3  # not a byte from before the offset
    grown.commit()
    put(a, b"z\n", 1020)  # shrunk
    put(c, b"d1\n" * 9, 1020)  # greater, but another file
    put(b, b"b3", 1020, "ab")
    new = R.begin(spark, str(root), index)
    assert lines(new.lines) == ["z", *["d1"] * 9]
    new.commit()
    put(b, b"\n", 1030, "ab")
    os.remove(a)
    last = R.begin(spark, str(root), index)
    assert lines(last.lines) == ["b3"]
    last.commit()
    assert len(R.load_index(index)) == 3
    assert sorted(os.listdir(index)) == [f"offsets-{i:08d}.parquet" for i in range(1, 5)]


def test_large_file_is_read_from_its_offset_only(spark, tmp_path):
    root, index = tmp_path / "logs", str(tmp_path / "index")
    put(root / "big.jsonl", b"".join(b'{"n": %d}\n' % i for i in range(200_000)), 1000)
    one = R.begin(spark, str(root), index, range_bytes=1 << 18)
    assert one.report.count() == len(one.lines.rdd.glom().collect()) > 5
    total = one.report.selectExpr("sum(lines) n", "sum(bytes_read) b").first()
    size = os.path.getsize(root / "big.jsonl")
    assert total.n == 200_000 and size <= total.b < size * 1.5
    one.commit()
    put(root / "big.jsonl", b'{"n": -1}\n', 1010, "ab")
    two = R.begin(spark, str(root), index)
    assert lines(two.lines) == ['{"n": -1}'] and two.report.first().bytes_read == 10


def test_index_of_another_format(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FORMAT", 2)
    R.save_index(str(tmp_path / "i"), {"a": R.State(1, 2, 3, "x")})
    assert R.load_index(str(tmp_path / "i")) == {"a": R.State(1, 2, 3, "x")}
    monkeypatch.setattr(R, "FORMAT", 1)
    with pytest.raises(ValueError):
        R.load_index(str(tmp_path / "i"))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    root, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    put(root / "a.jsonl", b"a1\na2\nha", 1000)

    def run():
        q = R.stream(spark, str(root), 4).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.line for r in spark.read.schema("path string, place long, line string").parquet(out).collect())

    assert run() == ["a1", "a2"]
    put(root / "a.jsonl", b"lf\na4\n", 1010, "ab")
    put(root / "b.jsonl", b"b1\n", 1010)
    assert run() == ["a1", "a2", "a4", "b1", "half"]
    assert run() == ["a1", "a2", "a4", "b1", "half"]
    put(root / "b.jsonl", b"c1\nc2\n", 1020)  # replaced by a greater one
    assert run() == ["a1", "a2", "a4", "b1", "c1", "c2", "half"]
