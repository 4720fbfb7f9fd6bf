"""Mail stores on disk as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import codecs
from postmeter.operators.mailbox import encode_flags, file_id_flags

# The checksum layer of the local file system cannot open names with a colon, which
# message files have. These options only concern file: paths.
PLAIN_LOCAL_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def folder_roots(spark: SparkSession, root: str) -> list[str]:
    """The store and patterns for its folders, whose directories start with a dot.

    A recursive scan passes over such directories, so each level of them is named.
    Only directories are looked at here, until a level has none.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    patterns = [root.rstrip("/")]
    while True:
        level = hadoop.Path(patterns[-1] + "/.*/*")
        hits = level.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(level)
        if hits is None or not any(h.isDirectory() for h in hits):
            return patterns
        patterns.append(patterns[-1] + "/.*")


def folder_of_directory(directory: Column, layout: str = "dots") -> Column:
    """Folder path from the directory of a message file.

    ``dots``: ``.A.B`` is folder A/B, the store root the empty path. ``nested``:
    ``A/.B.directory/C`` style stores, where a subfolder lies in the hidden
    directory of its parent.
    """
    if layout == "dots":
        parts = F.split(F.regexp_replace(directory, r"^\.", ""), r"\.")
        names = F.when(F.startswith(directory, F.lit(".")), parts).otherwise(F.array().cast("array<string>"))
    else:
        steps = F.filter(F.split(directory, "/"), lambda s: s != "")
        names = F.transform(steps, lambda s: F.regexp_replace(s, r"^\.(.*)\.directory$", "$1"))
    return F.transform(names, codecs.folder_name_text)


def message_files(files: DataFrame, root: str, layout: str = "dots") -> DataFrame:
    """Keep the messages among ``path`` rows: files in new/ and cur/ whose name has no leading dot."""
    base = root.rstrip("/")
    relative = F.regexp_replace("path", rf"^.*\Q{base}\E/?", "")
    pattern = r"^(?:(.*)/)?(new|cur)/([^/]+)$"
    name = F.url_decode(F.replace(F.regexp_extract(relative, pattern, 3), F.lit("+"), F.lit("%2B")))
    parsed = files.withColumns(
        {
            "file_name": name,
            "state": F.regexp_extract(relative, pattern, 2),
            "folder": folder_of_directory(F.regexp_extract(relative, pattern, 1), layout),
        }
    )
    kept = parsed.filter(F.col("state").isin("new", "cur") & ~F.startswith("file_name", F.lit(".")))
    facts = file_id_flags(F.col("file_name"))
    # A message in new/ has no flags yet, whatever its name says.
    return kept.withColumns(
        {"uid": facts["id"], "flags": F.when(F.col("state") == "new", F.lit(0)).otherwise(facts["flags"])}
    )


def _files(spark: SparkSession, root: str) -> DataFrame:
    """All files of the store, at any depth of folders; the levels are listed anew with each call."""
    return (
        spark.read.format("binaryFile")
        .options(**PLAIN_LOCAL_FILES)
        .option("recursiveFileLookup", "true")
        .load(folder_roots(spark, root))
    )


def scan_maildir(spark: SparkSession, root: str, layout: str = "dots", content: bool = True) -> DataFrame:
    """``folder, uid, flags, size, file_name[, raw]`` of all messages under a store. Files are never moved.

    Without ``content`` the file bytes are not read. An empty file is no message and gives no row.
    """
    rows = message_files(_files(spark, root), root, layout)
    cols = ["folder", "uid", "flags", F.col("length").alias("size"), "file_name"]
    return rows.select(*cols, *([F.col("content").alias("raw")] if content else []))


#: Tasks of a scan of message files that are one task where the files are only listed.
_LISTED_TOGETHER = 32


def store_listing(spark: SparkSession, root: str, layout: str = "dots") -> DataFrame:
    """``folder, uid, flags, size, state, ts, path`` of all messages, without their bytes.

    Spark counts the opening of a file as 4 MB, so a task takes 32 of them. Nothing is opened here: a
    task takes that many times more, and a listing that is written has as many files fewer.
    """
    files = _files(spark, root).select("path", "modificationTime", "length")
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // _LISTED_TOGETHER)
    rows = message_files(files.coalesce(tasks), root, layout)
    return rows.select("folder", "uid", "flags", F.col("length").alias("size"), "state", F.col("modificationTime").alias("ts"), "path")


def listed_messages(spark: SparkSession, listing: DataFrame, root: str) -> DataFrame:
    """The listing with ``raw``. Files that are older than all listed ones are not opened."""
    since = listing.agg(F.min("ts")).first()[0]
    if since is None:
        return listing.withColumn("raw", F.lit(None).cast("binary"))
    recent = _files(spark, root).filter(F.col("modificationTime") >= F.lit(since))
    return listing.join(recent.select("path", F.col("content").alias("raw")), "path").select(*listing.columns, "raw")


def directory_of_folder(folder: Column, layout: str = "dots") -> Column:
    """The directory of a folder below the store, with a slash behind it; the empty path is the store itself."""
    names = F.transform(folder, codecs.folder_name_encoded)
    if layout == "dots":
        below = F.concat(F.lit("."), F.array_join(names, "."), F.lit("/"))
    else:
        above = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: F.concat(F.lit("."), n, F.lit(".directory/")))
        below = F.concat(F.array_join(above, ""), F.element_at(names, -1), F.lit("/"))
    return F.when(F.size(folder) > 0, below).otherwise("")


def write_maildir(messages: DataFrame, root: str, layout: str = "dots") -> int:
    """Writes ``folder, uid, flags, raw`` rows as message files and returns how many.

    Tasks write their own files, first under ``tmp/``, so that a reader sees whole messages only.
    A row's file name follows from its columns: a task that runs again writes the same files.
    Messages without flags lie in ``new/``, others in ``cur/``.
    """
    named = encode_flags(messages)
    is_new = F.col("flags") == 0
    rows = named.select(
        directory_of_folder(F.col("folder"), layout).alias("directory"),
        F.when(is_new, "new").otherwise("cur").alias("state"),
        F.when(is_new, F.col("uid")).otherwise(F.col("file_name")).alias("name"),
        F.col("raw").cast("binary").alias("raw"),
    )
    place = root.replace("file:///", "/").replace("file:/", "/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        made: set[str] = set()
        for batch in batches:
            for directory, state, name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                home = f"{base.rstrip('/')}/{directory}"
                if directory not in made:
                    for d in ("new", "cur", "tmp"):
                        store.create_dir(home + d, recursive=True)
                    made.add(directory)
                with store.open_output_stream(f"{home}tmp/{name}") as f:
                    f.write(raw or b"")
                store.move(f"{home}tmp/{name}", f"{home}{state}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return rows.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0
