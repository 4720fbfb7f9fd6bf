"""One case for each former cap, prefix or crash: long headers, deep trees and comments, whole texts."""

import pytest
from pyspark.sql import functions as F

from postmeter.functions import mail, text
from postmeter.operators import bodies, headers, mailbox, metrics, weblog

LINES = 50_000


@pytest.mark.parametrize("lines", ["bad\n" + " more\n" * LINES, "A: 1\n" + " \n" * LINES + " end\n", "A: 1\n" + " x\n" * LINES])
def test_long_headers(spark, lines):
    raw = lines + "B: 2\n\nbody"
    row = headers.with_headers(spark.createDataFrame([("k", raw)], "msg_key string, raw string"), True).first()
    assert row["headers"][-1]["name"] == "B" and row["body"] == "body"


def test_long_encoded_word(spark):
    value = "=?utf-8?q?" + "x" * LINES + "?= =?utf-8?q?y?="
    got = spark.createDataFrame([(value,)], "v string").select(mail.decoded(F.col("v")).alias("r")).first()["r"]
    assert got == "x" * LINES + "y"


def nested(depth):
    if depth == 0:
        return "Content-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nleaf"
    b = f"b{depth}x"
    return f"Content-Type: multipart/mixed; boundary={b}\r\n\r\n--{b}\r\n{nested(depth - 1)}\r\n--{b}--\r\n"


def test_attachments_at_any_depth(spark):
    df = spark.createDataFrame([(str(d), nested(d)) for d in range(1, 8)], "msg_key string, raw string")
    parts = bodies.explode_parts(df)
    counts = {r["msg_key"]: r["count"] for r in parts.groupBy("msg_key").count().collect()}
    assert counts == {str(d): d + 1 for d in range(1, 8)}
    files = bodies.attachments(parts).filter("is_attachment")
    assert sorted(r["msg_key"] for r in files.collect()) == [str(d) for d in range(1, 8)]


def test_part_tree_in_one_pass(spark):
    """Prologs, epilogs, sizes, lines that only look like boundaries, unclosed and closed multiparts, equal boundaries."""
    inner = 'Content-Type: multipart/alternative; boundary="in"\n\npre\n--in\n\none\n--inner\n--in\r\n\r\ntwo\r\n--in--  \nafter\n--x'
    raw = f"A: b\nContent-Type: multipart/mixed; boundary=out\n\n\n--  out\n{inner}\n--out\n\nlast\n-- \n--out--\nbye\n--in\n"
    lost = "Content-Type: multipart/mixed\n\n--guess\n\na\n--guess\nContent-Type: multipart/mixed; boundary=g2\n\n--g2\n\nb"
    same = "Content-Type: multipart/mixed; boundary=s\n\n--s\nContent-Type: multipart/mixed; boundary=s\n\n--s\n\nc\n--s--\n"
    head = "Content-Type: text/plain\n--odd: 1\nContent-Type: multipart/mixed; boundary=h\n\n--h\n\nd\n"
    late = "--odd: 1\nContent-Type: multipart/mixed; boundary=h\n\n--h\n\nd\n--h--"
    mails = {"raw": raw, "lost": lost, "same": same, "head": head, "late": late, "plain": "no header", "empty": "", "null": None}
    df = spark.createDataFrame(list(mails.items()), "msg_key string, raw string")
    got = {}
    for r in bodies.explode_parts(df).collect():
        got.setdefault(r.msg_key, {})[tuple(r.part_path)] = (r.n_children, r.body, r.prolog, r.epilog, r.size)
    body = raw.split("\n\n", 1)[1]
    region = inner.split("\n\n", 1)[1]
    assert got["raw"] == {
        (): (2, None, "", "bye\n--in\n", len(body)),
        (0,): (2, None, "pre", "after\n--x", len(region)),
        (0, 0): (0, "one\n--inner", None, None, 11),
        (0, 1): (0, "two", None, None, 3),
        (1,): (0, "last\n-- ", None, None, 8),
    }
    assert {k: v[:2] for k, v in got["lost"].items()} == {(): (2, None), (0,): (0, "a"), (1,): (1, None), (1, 0): (0, "b")}
    assert {k: v[:2] for k, v in got["same"].items()} == {(): (2, None), (0,): (0, ""), (1,): (0, "c")}
    assert {k: v[:2] for k, v in got["head"].items()} == {(): (0, "--h\n\nd\n")}
    assert {k: v[:2] for k, v in got["late"].items()} == {(): (1, None), (0,): (0, "d")}
    assert [got[k][()][0] for k in ("plain", "empty")] == [0, 0]


def test_many_parts_and_dashes(spark):
    """Work grows with the text: thousands of parts, and a text of lines that look like boundaries."""
    many = "Content-Type: multipart/mixed; boundary=b\n\n" + "".join(f"--b\n\np{i}\n" for i in range(5000)) + "--b--\n"
    lines = "Content-Type: multipart/mixed; boundary=b\n\n--b\n\n" + "--a\n" * 20_000 + "--b--\n"
    df = spark.createDataFrame([("m", many), ("l", lines)], "msg_key string, raw string")
    parts = bodies.explode_parts(df).cache()
    assert parts.filter("msg_key = 'm'").count() == 5001 and parts.filter("msg_key = 'm' and body = 'p4999'").count() == 1
    assert parts.filter("msg_key = 'l' and depth = 1").first()["size"] == 4 * 20_000 - 1
    parts.unpersist()


def test_nothing_runs_when_parts_are_asked_for(spark):
    df = spark.createDataFrame([("k", nested(3))], "msg_key string, raw string")
    plan = bodies.explode_parts(df.withColumn("raw", F.concat("raw", F.raise_error(F.lit("ran")))))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Scan") == 1


@pytest.mark.parametrize("depth", [1, 4, 5, 9, 40])
def test_comments_at_any_depth(spark, depth):
    value = "(" * depth + "deep" + ")" * depth + "a@b"
    row = spark.createDataFrame([(value,)], "v string").select(mail.mailbox(F.col("v")).alias("m"), mail.address_list(F.col("v")).alias("l")).first()
    assert row["m"]["address"] == "a@b" and len(row["l"]) == 1


def test_whole_texts(spark):
    df = spark.createDataFrame([("x" * 5000 + "<h1>late</h1>",)], "html string")
    assert metrics.reply_text(df, "html").first()["reply"] == "late"
    assert metrics.reply_text(df, "html", limit=1023).first()["reply"] is None
    long = spark.createDataFrame([("line\n" * 10_000,)], "t string")
    assert long.select(text.choose_encoding(F.col("t"))).first()[0] == "7bit"
    assert long.select(text.choose_encoding(F.col("t"), inspect_below=32768)).first()[0] == "base64"


def test_nulls_in_reports(spark):
    rows = spark.createDataFrame([("n", "A", None), ("n", "B", "1")], "node string, metric string, value string")
    assert metrics.metrics_tsv(rows, ["node"]).first()["document"] == "A\t\nB\t1\n\n"
    named = rows.selectExpr("node", "nullif(metric, 'A') AS metric", "timestamp'2024-01-01' AS ts", "1L AS id", "value")
    assert metrics.to_snapshot(named, ["node"]).first()["snapshot"] == {"B": "1"}


def test_access_lists(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "ip string")
    assert weblog.ip_access(df, "ip", "").first()["access"] == 0
    assert weblog.ip_access(df, "ip", "+10.0.0.0/8,").first()["access"] == 1
    plan = weblog.ip_access(df, "ip", "+10.0.0.0/8,-10.1.0.0/16")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_log_line_with_the_separator(spark):
    line = '1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /a\x01b HTTP/1.1" 200 12 - -'
    rows = weblog.parse_access_log(spark.createDataFrame([(line,), ("no\x01line",)], "l string"), "l").collect()
    assert [r["uri"] for r in rows] == ["/a\x01b"]


def test_several_updates_of_a_message(spark):
    state = spark.createDataFrame([("f", "1", 1), ("f", "2", 1)], "folder string, uid string, flags int")
    updates = spark.createDataFrame(
        [("f", "1", "add", 4, 2), ("f", "1", "set", 2, 1), ("f", "1", "remove", 2, 3)], "folder string, uid string, mode string, mask int, seq int"
    )
    got = {r["uid"]: r["flags"] for r in mailbox.update_flags(state, updates).collect()}
    assert got == {"1": 4, "2": 1}


def test_values_of_a_field_stay_on_the_row(spark):
    df = spark.createDataFrame([("k", "A: 1\nb: x\na: 2\n\nbody"), ("n", "B: y\n\n")], "msg_key string, raw string")
    flat = headers.explode_headers(df)
    assert headers.field_all(df, "a").collect() == headers.header(flat, "A", all=True).collect()
    assert headers.field(df, "b").collect()[0].value == "x"
    assert "Exchange" not in headers.field_all(df, "a")._jdf.queryExecution().executedPlan().toString()


def test_rare_subjects_and_reply_to(spark):
    raw = "From: a@b\nReply-To: R <r@b>\nSubject: =?koi8-r?B?8NLJ18XU?= =?utf-8?q?!?=\nMessage-ID: <m@b>\n\nx"
    df = spark.createDataFrame([("k", raw), ("n", "Subject: plain\n\nx")], "msg_key string, raw string")
    row, plain = headers.envelope(df, rare=True).orderBy("msg_key").collect()
    assert (row.subject, row.reply_to.address, row.message_id, plain.subject) == ("Привет!", "r@b", "m@b", "plain")
    plan = headers.envelope(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_receipt_disposition_is_typed(spark):
    value = "manual-action/MDN-sent-manually; deleted/error, warning"
    df = spark.createDataFrame([("k", 0, "Disposition", value)], "msg_key string, pos int, name string, value string")
    row = headers.typed_headers(df).first()
    assert tuple(row.receipt) == ("manual-action", "MDN-sent-manually", "deleted", ["error", "warning"])


def test_append_to_a_new_folder(spark):
    kind = "folder array<string>, num bigint, uid string, flags int, modseq bigint"
    state = spark.createDataFrame([(["a"], 4, "4", 0, 1)], kind)
    rows = spark.createDataFrame([(["new"], "s1", 1, 2), (["new"], "s2", 0, 2), (["a"], "s3", 0, 2)], "folder array<string>, source string, flags int, modseq bigint")
    got = sorted((r.folder[0], r.num) for r in mailbox.append(state, rows).collect())
    assert got == [("a", 4), ("a", 5), ("new", 1), ("new", 2)]


def test_fetch_of_a_missing_column(spark):
    state = spark.createDataFrame([("f", 1)], "folder string, num int")
    with pytest.raises(ValueError, match="flags"):
        mailbox.fetch(state, ["flags"])
