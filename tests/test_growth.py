"""Work per row that grows with the row's size alone, and steps that are computed once."""

import time

from pyspark.sql import functions as F

from postmeter.operators import compose as c
from postmeter.operators import headers as h


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_kind_is_chosen_once(spark):
    """The kind looks at the whole text, so it may not stand inside the words."""
    rows = spark.createDataFrame([("é" * 30,), ("plain",), ("ab é " * 20,), (None,)], "s string")
    encoded = h.encode_words(rows, "s", chunk=7)
    assert encoded._jdf.queryExecution().analyzed().toString().count("regexp_count") == 1
    back = [r.s for r in h.decode_words(encoded, "s").collect()]
    assert back == ["é" * 30, "plain", "ab é " * 20, None]


def test_fold_without_blanks_is_quick(spark):
    """Long lines without a blank are not tried place by place; other lines fold as before."""
    at = r"(?=[^\r\n]{77})([^\r\n]{1,76}) (?=\S)"
    cases = ["", "a b", "x" * 200, "ab " * 60, "x" * 90 + " y" * 50, "a" * 75 + "  b c" * 30, " lead " * 40, "ab " * 60 + "\r\n " + "y " * 70 + "\n\n", None]
    rows = spark.createDataFrame([(s,) for s in cases], "s string")
    got = rows.select(c.fold(F.col("s")).alias("new"), F.regexp_replace("s", at, "$1\r\n ").alias("old")).collect()
    assert [r.new for r in got] == [r.old for r in got]
    long = spark.range(4).select(F.array_join(F.array_repeat(F.repeat(F.lit("x"), 600), 4000), "\r\n ").alias("s"))
    times = {}
    for name, folded in (("old", F.regexp_replace("s", at, "$1\r\n ")), ("new", c.fold(F.col("s")))):
        begin = time.monotonic()
        assert long.agg(F.sum(F.length(folded))).first()[0] == 4 * (4000 * 603 - 3)
        times[name] = time.monotonic() - begin
    assert times["new"] < times["old"] / 2, times


def test_parse_is_not_put_into_filters(spark):
    """A filter or join behind the parse reads its columns; the parse stands in the plan once."""
    from postmeter.operators import bodies as b

    raw = "From: a@b\r\nContent-Type: multipart/report; boundary=x\r\n\r\n--x\r\n\r\none\r\n--x--\r\n"
    messages = spark.createDataFrame([("k", raw)], "msg_key string, raw string")
    found = h.field(messages, "from")
    assert [r["value"] for r in found.collect()] == ["a@b"]
    one = plan_of(h.with_headers(messages)).count("regexp_replace")
    assert plan_of(found).count("regexp_replace") == one
    parts = b.explode_parts(messages)
    once = plan_of(parts).count("split(")
    assert plan_of(b.attachment_inventory(parts).select("msg_key")).count("split(") <= once
    assert plan_of(parts.filter("type is null and content_id is null")).count("split(") <= once
    assert [tuple(r) for r in parts.filter("type is null").select("part_path", "body").collect()] == [([0], "one")]


def test_date_is_taken_apart_once(spark):
    """The pattern of a date stands in the plan once, whatever is read from it."""
    from postmeter.functions import dates

    rows = spark.createDataFrame([("Mon, 01 Jan 2024 10:00:00 +0530",), (None,)], "s string")
    read = rows.select(dates.mail_date(F.col("s")).alias("d")).select("d.ts", "d.zone_min")
    assert plan_of(read).count("regexp_replace") <= 2
    got = read.select(F.unix_seconds("ts"), "zone_min").collect()
    assert [tuple(r) for r in got] == [(1704083400, 330), (None, None)]


def test_one_row_group_uses_all_cores(spark, tmp_path):
    """A file of one row group is cut into many splits, but only one of them has rows."""
    from postmeter.sources.tables import texts

    rows = spark.range(4000).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.uuid())).alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert spark.read.parquet(str(tmp_path / "rows.parquet")).rdd.getNumPartitions() >= cores
        used = texts(spark, str(tmp_path), "rows").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(used) >= cores and sum(r["count"] for r in used) == 4000


def test_ranges_hold_no_numbers(spark):
    """Islands come from sorted numbers; only islands at the edge of a slice are grouped."""
    from postmeter.operators import mailbox as mb

    ns = [1, 1, 2, 3, 3, 5, 7, 8, 9, 15, 16, 16, 17, None, -1, -2, 0]
    rows = spark.createDataFrame([(k, n) for k in ("a", None) for n in ns] + [("b", None), ("c", 4)], "k string, n long")
    got = mb.to_ranges(rows, ["k"], "n", width=4)
    assert plan_of(got).count("Aggregate") == 1
    want = [(-2, 3), (5, 5), (7, 9), (15, 17)]
    assert sorted((str(r.k), r.lo, r.hi) for r in got.collect()) == sorted([(k, *x) for k in ("a", "None") for x in want] + [("c", 4, 4)])


def test_fill_forward_sorts_once(spark):
    """What a slice ends with comes from its window: no grouping by sort, and the rows are computed once."""
    from postmeter.workloads import QUERIES

    df = QUERIES["m11_fill_forward"](spark, "/root/testdata/sf0.001")
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Union") == 1 and plan.count("REPARTITION_BY_NUM") == 2


def test_objects_are_opened_once(spark):
    """Html texts and the objects they show come from one parse of their message."""
    from postmeter.operators import bodies as b
    from postmeter.workloads import QUERIES

    for name in ("e42_embedded_objects", "j6_embedded_coverage"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
    part = "\r\n--B\r\nContent-Type: image/{}\r\n{}\r\n\r\n1"
    raw = (
        "Content-Type: multipart/related; boundary=B\r\nContent-ID: <a>\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<img src=\"cid:a\"> http://h/2"
        + part.format("png", "Content-ID: <a>") + part.format("gif", "Content-ID: <no>\r\nContent-Location: http://h/2")
        + part.format("png", "Content-ID: <no>") + part.format("bmp", "Content-Location: http://h/2") + "\r\n--B--"
    )
    messages = spark.createDataFrame([("k", raw), ("l", "From: a@b\r\n\r\nx"), (None, raw)], "msg_key string, raw string")
    parts = b.explode_parts(messages)
    got = sorted((r.msg_key, list(r.html_path), list(r.object_path), r.rule, r.ref) for r in b.embedded_objects(parts).collect())
    assert got == [("k", [0], [1], "id", "a"), ("k", [0], [2], "location", "http://h/2"), ("k", [0], [4], "location", "http://h/2")]
    seen = sorted((str(r.msg_key), list(r.part_path), r.subtype, r.shown) for r in b.object_coverage(parts).collect())
    each = lambda key, known: [(key, [], "related", False), (key, [1], "png", known), (key, [2], "gif", known), (key, [3], "png", False)]
    assert seen == each("None", False) + each("k", True)


def test_header_end_is_found_without_the_body(spark):
    """Time to split a message does not grow with the lines of its body as a scan of all of them does."""
    from postmeter.functions import mail

    raw = F.concat(F.lit("A: b\r\n\r\n"), F.repeat(F.lit("word " * 14 + "\r\n\r\n"), 20000))
    rows = spark.range(0, 40, 1, 1).select(F.concat(raw, F.col("id").cast("string")).alias("t"))
    cases = ["A: b\n\nbody\n\nmore", "\n\nx", "no end", "", " \nbody", "bad line\n \nbody", "A: b\n \nB: c\r\n\r\n", None]
    texts = spark.createDataFrame([(c,) for c in cases], "t string")
    old = lambda c: F.split(F.concat(F.lit("\n"), c), mail.HEADER_END, 2)
    assert texts.filter(~mail.split_message(F.col("t")).eqNullSafe(old(F.col("t")))).count() == 0
    times = {}
    for name, rule in (("new", mail.split_message), ("old", old), ("new", mail.split_message)):
        begin = time.monotonic()
        assert rows.agg(F.sum(F.size(rule(F.col("t"))))).first()[0] == 80
        times[name] = time.monotonic() - begin
    assert times["new"] < times["old"] * 0.7, times


def test_printable_is_unescaped_in_one_pass(spark):
    """Quoted-printable does not look for each printable character apart."""
    from postmeter.functions import codecs

    plan = plan_of(spark.range(1).select(codecs.quoted_printable(F.col("id").cast("string")).alias("t")))
    assert plan.count("replace(") < 10
    cases = ["a=b?", "100% a+b %41", " x \r\n.y \n\t~\x7f", "é😀", "", None, "." * 100, "a b " * 40 + " "]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.q for r in rows.select(codecs.quoted_printable(F.col("t")).alias("q")).collect()]
    assert got[:6] == ["a=3Db=3F", "100% a+b %41", " x=20\r\n=2Ey=20\n=09~=7F", "=C3=A9=F0=9F=98=80", "", None]
    assert got[6] == "=2E" + "." * 70 + "=\r\n=2E" + "." * 28
    back = [r.b for r in rows.select(codecs.quoted_printable_bytes(codecs.quoted_printable(F.col("t"))).alias("b")).collect()]
    assert [x if x is None else bytes(x).decode() for x in back] == cases


def test_listing_takes_many_files_a_task(spark, tmp_path):
    """Files that are not opened are not counted as megabytes: a store needs few tasks to be listed."""
    from postmeter.sources import maildir

    mails = spark.range(1500).select(
        F.array(F.lit("box")).alias("folder"), F.concat(F.lit("m"), "id").alias("uid"), (F.col("id") % 2).cast("int").alias("flags"), F.lit("A: b").alias("raw")
    )
    root = str(tmp_path / "store")
    maildir.write_maildir(mails, root, "nested")
    listed = maildir.store_listing(spark, root, "nested")
    assert listed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < 1500 // 32
    got = listed.groupBy("folder", "state", "flags", "size").count().collect()
    assert sorted((list(r.folder), r.state, r.flags, r.size, r["count"]) for r in got) == [(["box"], "cur", 1, 4, 750), (["box"], "new", 0, 4, 750)]
