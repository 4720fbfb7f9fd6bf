"""Readers that turn many nodes, or one list of addresses, into one table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from postmeter.functions import fixed
from postmeter.plans.workspace import new_folder


#: Nodes that are added to a table with one statement.
_AT_ONCE = 500


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _single_files(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """The nodes whose path is a file, with its full name."""
    hadoop = spark._jsc.hadoopConfiguration()

    def full_name(item: tuple[str, str]) -> tuple[str, str] | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(item[1])
        status = place.getFileSystem(hadoop).getFileStatus(place)
        return (item[0], status.getPath().toUri().toString()) if status.isFile() else None

    with ThreadPoolExecutor(16) as pool:
        return dict(x for x in pool.map(full_name, paths.items()) if x)


def _read_files(spark: SparkSession, files: Mapping[str, str], fmt: str, columns: list[StructField]) -> DataFrame:
    by_name: dict[str, list[str]] = {}
    for node, path in files.items():
        by_name.setdefault(path, []).append(node)
    rows = spark.read.format(fmt).schema(StructType(columns)).load(sorted(by_name))
    nodes = F.create_map(*[x for p, n in by_name.items() for x in (F.lit(p.removeprefix("file:").lstrip("/")), F.array(*map(F.lit, n)))])
    own = F.ltrim(F.regexp_replace(F.col("_metadata.file_path"), "^file:", ""), F.lit("/"))
    return rows.select("*", F.explode(nodes[own]).alias("node"))


def read_nodes(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """One table from one path per node, with a ``node`` column.

    The nodes are partitions of an external table, each at its own place: one scan, whatever
    their number, and filters on ``node`` leave the others unread. Columns that a node lacks are
    null; without a ``schema`` those of all nodes are merged in a job. The table is listed in the
    session's catalog under a name of its own and holds no files. Nodes that are single files
    cannot be partitions; they share one scan more and find their node by the file's name.
    """
    if schema is None:
        merged = spark.read.format(fmt).option("mergeSchema", "true").load(sorted(set(paths.values())))
        schema = merged.schema
    columns = [f for f in schema.fields if f.name != "node"]
    single = _single_files(spark, paths)
    if len(single) == len(paths):
        return _read_files(spark, single, fmt, columns)
    name = f"nodes_{uuid.uuid4().hex}"
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(
        f"CREATE TABLE {name} ({listed}, node STRING) USING {fmt} PARTITIONED BY (node) LOCATION {_quoted(new_folder(spark, name))}"
    )
    nodes = sorted((n, p) for n, p in paths.items() if n not in single)
    for at in range(0, len(nodes), _AT_ONCE):
        added = " ".join(f"PARTITION (node = {_quoted(n)}) LOCATION {_quoted(p)}" for n, p in nodes[at : at + _AT_ONCE])
        spark.sql(f"ALTER TABLE {name} ADD {added}")
    found = spark.table(name)
    return found.unionByName(_read_files(spark, single, fmt, columns)) if single else found


def read_nodes_jdbc(
    spark: SparkSession, urls: Mapping[str, str], table: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """The same over JDBC, one remote table per node."""
    parts = [
        spark.read.format("jdbc")
        .options(**(options or {}), url=url, dbtable=table)
        .load()
        .withColumn("node", F.lit(node))
        for node, url in sorted(urls.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def endpoint_of(url: Column) -> Column:
    """``struct(scheme, host, port, path)`` of one address; null when it is not valid."""
    pattern = r"(?s)^(mysqls?|https?|smtps?)://([^:/]+)(?::([0-9]+))?(/.*)?$"
    scheme = F.regexp_extract(url, pattern, 1)
    given = F.regexp_extract(url, pattern, 3)
    default = F.create_map(*[F.lit(x) for kv in fixed.DEFAULT_PORTS.items() for x in kv])[scheme]
    path = F.regexp_extract(url, pattern, 4)
    return F.when(
        scheme != "",
        F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(url, pattern, 2).alias("host"),
            F.coalesce(given.try_cast("int"), default).alias("port"),
            F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        ),
    )


def _listed(df: DataFrame, col: str) -> DataFrame:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(F.split(F.col(col), ",")).alias("pos", "url")).withColumn("e", endpoint_of(F.col("url")))


def parse_endpoints(df: DataFrame, col: str) -> DataFrame:
    """Split comma lists of addresses and parse each; addresses that are not valid give no row, see ``endpoint_rejects``."""
    keep = [c for c in df.columns if c != col]
    good = _listed(df, col).filter(F.col("e").isNotNull())
    return good.select(*keep, "pos", "url", "e.*", F.replace(F.col("e.path"), F.lit("/"), F.lit("")).alias("node"))


def endpoint_reject(url: Column) -> Column:
    """Why an address is not valid, or null."""
    scheme = F.regexp_extract(url, r"(?s)^([^:/]*)://", 1)
    return (
        F.when(url == "", "empty")
        .when(endpoint_of(url).isNotNull(), F.lit(None))
        .when(scheme == "", "no scheme")
        .when(~scheme.isin(*fixed.DEFAULT_PORTS), "unknown scheme")
        .when(F.rlike(url, F.lit(r"(?s)^[^:/]*://[:/]")) | F.rlike(url, F.lit(r"(?s)^[^:/]*://$")), "no host")
        .otherwise("other form")
    )


def endpoint_rejects(df: DataFrame, col: str) -> DataFrame:
    """The addresses that ``parse_endpoints`` leaves out, with their place in the list and the reason."""
    keep = [c for c in df.columns if c != col]
    bad = _listed(df, col).filter(F.col("e").isNull())
    return bad.select(*keep, "pos", "url", endpoint_reject(F.col("url")).alias("reason"))


def parse_listing(df: DataFrame, col: str) -> DataFrame:
    """``n value`` lines to rows; inner blanks stay, the first entry of a number wins."""
    keep = [c for c in df.columns if c != col]
    pattern = r"^[ \t]*([0-9]*)[^ \t]*[ \t]+([^\r\n]+)$"
    lines = df.select(*keep, F.posexplode(F.split(F.col(col), r"\r?\n")).alias("pos", "line"))
    return (
        lines.filter(F.rlike("line", F.lit(pattern)))
        .withColumn("number", F.coalesce(F.regexp_extract("line", pattern, 1).try_cast("bigint"), F.lit(0)))
        .groupBy(*keep, "number")
        .agg(F.min_by(F.regexp_extract("line", pattern, 2), "pos").alias("value"))
    )


def write_contents(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Content rows ``name, content, content_type`` in a folder; a job that is run again overwrites it.

    Rows are rebalanced by name at run time, so files have the size that the
    session advises, and one busy name is split by its size. ``json`` keeps all columns, ``text``
    one content a line, its line ends escaped.
    """
    spread = df.select("name", "content", "content_type").hint("rebalance", "name")
    if fmt == "json":
        spread.write.mode("overwrite").json(path)
    else:
        line = F.replace(F.replace(F.replace("content", F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
        spread.select(line.alias("value")).write.mode("overwrite").text(path)
