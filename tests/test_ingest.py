"""Ingest of mail into tables: rows of all tables, and what lies on disk meanwhile."""

import base64
import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from postmeter.operators import bodies
from postmeter.plans import jobs

SCHEMA = "folder array<string>, msg_key string, raw string"


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath(): files.apply(i).length() for i in range(files.length())}


def _message(text):
    return f"From: a@b\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\npro\r\n--B\r\nX: 1\r\n\r\n{text}\r\n--B--\r\nepi"


@pytest.mark.parametrize("folders", [64, 0])
def test_ingest_keeps_texts_twice(spark, tmp_path, monkeypatch, folders):
    """Besides messages and parts only a slice of staged parts and no shuffled texts are on disk."""
    monkeypatch.setattr(jobs, "FOLDERS", folders, raising=False)
    monkeypatch.setattr(jobs, "SLICE_BYTES", 1, raising=False)
    rng = random.Random(4)
    text = lambda: base64.b64encode(rng.randbytes(30_000)).decode()
    rows = [(["f", str(i % 3)], f"m{i}", _message(text())) for i in range(400)]
    source = f"{tmp_path}/source"
    spark.createDataFrame(rows, SCHEMA).repartition(16).write.parquet(source)
    seen, out, write = {}, f"{tmp_path}/out", DataFrameWriter.parquet
    before = _shuffled(spark)

    def watched(self, path, *a, **b):
        write(self, path, *a, **b)
        shuffled = sum(size for file, size in _shuffled(spark).items() if file not in before)
        seen[os.path.basename(path), len(seen)] = _bytes(out) + shuffled

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(jobs, "FILE_BYTES", 1, raising=False)
    counts = jobs.ingest(spark, spark.read.parquet(source), out)
    assert sorted((r.folder, r.messages, r.parts, r.headers, r.depth) for r in counts.collect()) == [
        ("f/0", 134, 268, 402, 1), ("f/1", 133, 266, 399, 1), ("f/2", 133, 266, 399, 1)
    ]
    assert max(seen.values()) < 2.6 * _bytes(f"{out}/messages")
    assert not os.path.exists(f"{out}/_staging")


def test_ingest_tables(spark, tmp_path, monkeypatch):
    """All tables hold the rows of one parse, by any way of writing them, and the same when the job is run again."""
    rows = [(["f", str(i % 5)], f"m{i % 7}", _message("x" * i)) for i in range(40)]
    rows += [(["f", "0"], "e", ""), (["f", "1"], None, None), (["g"], "n", "no fields"), (None, "o", "A: 1\r\n\r\nb"), (["f", "0"], None, "A: 1\r\n\r\nb")]
    source = spark.createDataFrame(rows, SCHEMA).repartition(6)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(key)
    good = source.filter("length(raw) > 0 and raw <> 'no fields'").withColumn("folder", F.array_join("folder", "/"))
    parts = bodies.explode_parts(good)
    fields = parts.select("msg_key", "part_path", F.inline("headers"), "folder")
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{tmp_path}/{name}")
    for folders, slice_bytes in ((64, 1), (0, 1 << 20)):
        monkeypatch.setattr(jobs, "FOLDERS", folders, raising=False)
        monkeypatch.setattr(jobs, "SLICE_BYTES", slice_bytes, raising=False)
        counts = jobs.ingest(spark, source, str(tmp_path))
        bare = parts.drop("headers")
        assert same(read("parts", bare.schema), bare)
        assert same(read("headers", fields.schema), fields)
        assert sorted(map(tuple, read("messages", "msg_key string, raw string, reason string, folder string").collect()), key=str) == sorted(
            [(k, t, None if t and ":" in t else "no header fields" if t else "empty", f and "/".join(f)) for f, k, t in rows], key=str
        )
        assert sorted(map(tuple, read("rejects", "folder string, reason string, messages bigint").collect())) == [
            ("f/0", "empty", 1), ("f/1", "empty", 1), ("g", "no header fields", 1)
        ]
        assert same(counts, jobs.ingest_counts(parts))
        assert spark.conf.get(key) == conf
