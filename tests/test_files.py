"""Ordered lines, committed files, shards bounded by bytes."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioforge.sources import ordered_json, readers, writers


def numbered(rows):
    return [r.v for r in sorted(rows, key=lambda r: (r.file, r.offset))]


@pytest.mark.parametrize("split", [150, 1000, 1 << 20])
def test_lines_of_many_files_and_splits_are_in_file_order(spark, tmp_path, split):
    rng, want, paths = random.Random(split), [], []
    for number, name in enumerate(("b.jsonl", "a.jsonl", "empty.jsonl", "c.jsonl")):
        lines = [] if "empty" in name else [json.dumps({"v": f"{number}-{i} " + "é" * rng.choice([0, 1, 40])}, ensure_ascii=False) for i in range(60)]
        end = "" if name.startswith("a") else "\n"
        (tmp_path / name).write_bytes((rng.choice(["\n", "\n\n", "\r\n"]).join(lines) + end).encode())
        want += [json.loads(line)["v"] for line in lines]
        paths.append(str(tmp_path / name))
    got = ordered_json.ordered_json(spark, paths, "v string", split_bytes=split).collect()
    assert numbered(got) == want
    for r in got[:: max(1, len(got) // 5)]:
        with open(paths[r.file], "rb") as file:
            file.seek(r.offset)
            assert json.loads(file.readline())["v"] == r.v


def test_splits_of_any_size_give_every_line_once():
    rng = random.Random(8)
    for _ in range(300):
        data = b"".join(rng.choice([b"", b"a", b"bb", b"c" * 30]) + b"\n" for _ in range(rng.randint(0, 12))) + rng.choice([b"", b"tail"])
        size, chunk, got = rng.randint(1, 40), rng.randint(1, 40), []
        for start in range(0, len(data), size):
            for at, whole in ordered_json._lines(io.BytesIO(data), start, min(start + size, len(data)), chunk):
                assert data[at : at + len(whole)] == whole and start <= at
                got.append(whole)
        assert b"".join(got) == data


def test_ordered_lines_of_nothing_and_of_bad_lines(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert ordered_json.ordered_json(spark, str(tmp_path / "none"), "v string").count() == 0
    with pytest.raises(FileNotFoundError):
        ordered_json.ordered_json(spark, str(tmp_path / "missing"), "v string")
    (tmp_path / "bad.jsonl").write_text('{"v":"x"}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        ordered_json.ordered_json(spark, str(tmp_path / "bad.jsonl"), "v string").collect()


def test_ordered_round_trip(spark, tmp_path):
    rows = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("v"), F.lit(None).cast("string").alias("n")).repartition(5)
    writers.ordered_json_lines(rows, f"{tmp_path}/j", "v")
    got = ordered_json.ordered_json(spark, f"file://{tmp_path}/j", "v long, n string", split_bytes=5000).collect()
    assert numbered(got) == list(range(3000))


# --- one file per row


def files_below(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_files_of_texts_bytes_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i % 3}/{i}.txt", f"é{i}") for i in range(40)], "name string, value string").repartition(5)
    writers.files(rows, f"file://{tmp_path}/t", "name", "value")
    assert files_below(tmp_path / "t") == {f"{i % 3}/{i}.txt": f"é{i}".encode() for i in range(40)}
    writers.files(spark.createDataFrame([("a.bin", bytearray(b"\x00\xff")), ("n.bin", None)], "name string, value binary"), str(tmp_path / "b"), "name", "value")
    assert files_below(tmp_path / "b") == {"a.bin": b"\x00\xff", "n.bin": b""}
    writers.files(spark.createDataFrame([("r.json", '{"a":[1,"é"]}')], "name string, value string"), str(tmp_path / "j"), "name", "value", pretty=True)
    assert files_below(tmp_path / "j")["r.json"].decode() == '{\n  "a": [\n    1,\n    "é"\n  ]\n}'
    writers.files(rows.limit(0), str(tmp_path / "none"), "name", "value")


@pytest.mark.parametrize("names", [["new", "old"], ["x", "x"], ["a", "../b"], ["a", ""]])
def test_nothing_is_written_unless_all_is(spark, tmp_path, names):
    folder = tmp_path / "f"
    os.makedirs(folder)
    (folder / "old").write_text("kept")
    with pytest.raises(Exception, match="FileExists|exist|two rows|not a name"):
        writers.files(spark.createDataFrame([(n, "v") for n in names], "name string, value string").repartition(2), str(folder), "name", "value")
    assert files_below(folder) == {"old": b"kept"} and os.listdir(folder) == ["old"]


def test_a_task_that_dies_once_gives_the_same_files(tmp_path):
    """Tasks are retried on a cluster of one's own machine only, so a session of its own runs this."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession, functions as F
from folioforge.sources import writers
spark = SparkSession.builder.master("local[2, 3]").config("spark.ui.enabled", "false").getOrCreate()
def dies(batches):
    from pyspark import TaskContext
    first = TaskContext.get().attemptNumber() == 0
    for batch in batches:
        rows = batch.to_pylist()
        if first and any(r["name"] == "7.txt" for r in rows):
            yield batch.slice(0, batch.num_rows // 2)
            os._exit(1)
        yield batch
rows = spark.range(40).repartition(3).select(F.concat(F.col("id"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("value"))
writers.files(rows.mapInArrow(dies, "name string, value string"), {str(tmp_path / "f")!r}, "name", "value")
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "Lost task" in done.stderr and files_below(tmp_path / "f") == {f"{i}.txt": str(i).encode() for i in range(40)}


# --- shards


def test_shards_are_near_the_limit_and_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{i:05}", "train" if i % 4 else "test", "x" * rng.randrange(30), None if i % 5 else [1, 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, split string, text string, ids array<int>").repartition(7)
    size = lambda r: 5 + len(r[1]) + len(r[2]) + (1 if r[3] is None else 16)
    assert {r.id: r.b for r in df.select("id", writers.row_bytes(df).alias("b")).collect()} == {r[0]: size(r) for r in rows}
    writers.sharded_dataset(df, f"{tmp_path}/d", "id", limit=5000)
    read = spark.read.parquet(f"{tmp_path}/d").select("id", "split", "shard", F.input_file_name().alias("f")).collect()
    assert len(read) == len(rows) and len({r.f for r in read}) == len({(r.split, r.shard) for r in read})
    sizes, by = {}, {r[0]: size(r) for r in rows}
    for r in sorted(read, key=lambda r: r.id):
        sizes.setdefault(r.split, {}).setdefault(r.shard, []).append(by[r.id])
    for split, shards in sizes.items():
        order = [r.shard for r in sorted(read, key=lambda r: r.id) if r.split == split]
        assert order == sorted(order) and list(shards) == list(range(len(shards)))
        assert all(abs(sum(v) - 5000) < 60 for k, v in shards.items() if k + 1 < len(shards))
    assert writers.shard_numbers(df.limit(0), "id", 5000).count() == 0


def test_whole_texts_keep_their_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert [r.value for r in readers.whole_texts(spark, str(tmp_path)).collect()] == ["x\ny\n"]


def test_listing_reads_names_only(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "a.txt").write_text("y")
    assert [os.path.basename(r.path) for r in readers.listing(spark, str(tmp_path), "*.txt").collect()] == ["a.txt", "b.txt"]
