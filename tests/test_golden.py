"""Small tables with malformed and unusual input, one case per rule."""

import pytest
from pyspark.sql import functions as F

from postmeter.functions import codecs, dates, mail, text, urls
from postmeter.operators import bodies, headers, mailbox, metrics, weblog
from postmeter.sources import nodes


def one(spark, value, rule, type_="string"):
    """Apply a column rule to one value."""
    df = spark.createDataFrame([(value,)], f"v {type_}")
    return df.select(rule(F.col("v")).alias("r")).first()["r"]


def many(spark, cases, rule):
    """Apply a rule to the inputs of ``(input, expected)`` cases and compare in one job."""
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", rule(F.col("v")).alias("r")).collect()}
    wrong = [(c[0], got[i], c[1]) for i, c in enumerate(cases) if got[i] != c[1]]
    assert not wrong, wrong


def test_like_any(spark):
    df = spark.createDataFrame([("A_B",), ("AXB",), ("version_x",), ("INNODBxf1",)], "name string")
    names = lambda pats: sorted(r[0] for r in metrics.like_any(df, "name", pats).collect())
    assert names([r"a\_b"]) == ["A_B"]
    assert names(["a_b"]) == ["AXB", "A_B"]
    assert names([]) == ["AXB", "A_B", "INNODBxf1", "version_x"]


def test_distribution(spark):
    files = [
        ("a", "/etc/lsb-release", 'X=1\nDISTRIB_DESCRIPTION="Ubuntu 8.04.4 LTS"\n'),
        ("a", "/etc/debian_version", "9.1\n"),
        ("b", "/etc/lsb-release", "DISTRIB_DESCRIPTION=Plain\n"),
        ("c", "/etc/SuSE-release", "openSUSE\nmore"),
        ("c", "/etc/debian_version", "9"),
        ("d", "/etc/passwd", "x"),
    ]
    df = spark.createDataFrame(files, "host string, path string, content string")
    got = {r["host"]: r["distribution"] for r in metrics.distribution(df).collect()}
    assert got == {"a": "lsb: Ubuntu 8.04.4 LTS", "b": "lsb: Plain", "c": "SuSE: openSUSE"}


def test_headers(spark):
    raw = "A: 1\r\n folded\r\n\ttwice  \r\nbad line\r\nB : two\nC:three\n   \n still C\n\nD: body\n"
    rows = headers.explode_headers(spark.createDataFrame([("k", raw)], "msg_key string, raw string")).collect()
    assert [(r["name"], r["value"]) for r in rows] == [
        ("A", "1 folded twice"), ("B", "two"), ("C", "three still C"),
    ]
    top = headers.with_headers(spark.createDataFrame([("k", "  \nA: 1\n")], "msg_key string, raw string"), True).first()
    assert top["headers"] == [] and top["body"] == "A: 1\n"
    bad = headers.with_headers(spark.createDataFrame([("k", "junk line\n \nA: 1\n")], "msg_key string, raw string"), True).first()
    assert bad["headers"] == [] and bad["body"] == "A: 1\n"
    end = headers.with_headers(spark.createDataFrame([("k", "A: no end")], "msg_key string, raw string"), True).first()
    assert end["headers"][0]["value"] == "no end" and end["body"] == ""


def test_words(spark):
    many(
        spark,
        [
            ("=?utf-8?B?w6lh?=", "éa"),
            ("=?ISO-8859-1*fr?q?=E9_a?=", "é a"),
            ("=?utf-8?Q?a?= =?utf-8?Q?b?=", "ab"),
            ("=?utf-8?Q?a?=\r\n =?utf-8?Q?b?=", "ab"),
            ("=?utf-8?Q?a?= c =?utf-8?Q?b?=", "a c b"),
            ("x =?utf-8?Q?a", "x =?utf-8?Q?a"),
            ("=?utf-8?X?a?=", "=?utf-8?X?a?="),
            ("plain  text", "plain  text"),
        ],
        mail.decoded,
    )
    df = spark.createDataFrame([("=?koi8-r?B?8NLJ18XU?= x",), ("=?utf-8?Q?=C3=A9?=",)], "v string")
    got = [r["v"] for r in headers.decode_words(df, "v", rare=True).collect()]
    assert got == ["Привет x", "é"]


def test_params(spark):
    many(
        spark,
        [
            ('text/plain; name="a;b\\"c"; charset=utf-8', {"name": 'a;b"c', "charset": "utf-8"}),
            ("x/y; name*0=ab; name*1=cd", {"name": "abcd"}),
            ("x/y; name*=utf-8'en'%C3%A9t%C3%A9", {"name": "été"}),
            ("x/y; name*0*=iso-8859-1'fr'%E9; name*1=t+1", {"name": "ét+1"}),
            ("x/y; name=plain; name*=us-ascii''star", {"name": "star"}),
            ("x/y; flag; a=1", {"a": "1"}),
            ("x/y", {}),
            ('x/y; name="=?utf-8?Q?=C3=A9?="', {"name": "é"}),
        ],
        mail.header_params,
    )


def test_addresses(spark):
    df = spark.createDataFrame(
        [
            (1, '"A, B" <a@x>, c@y (one, two), D <d@z>'),
            (2, "team: a@x, b@y; c@z"),
            (3, "none:;"),
            (4, "=?utf-8?Q?a,b?= <q@x>"),
            (5, "name <wrong <right@x>"),
        ],
        "k int, v string",
    )
    rows = headers.explode_addresses(df, "v").orderBy("k", "pos").collect()
    assert [(r["k"], r["group"], r["name"], r["email"]) for r in rows] == [
        (1, None, "A, B", "a@x"), (1, None, "", "c@y"), (1, None, "D", "d@z"),
        (2, "team", "", "a@x"), (2, "team", "", "b@y"), (2, None, "", "c@z"),
        (4, None, "a,b", "q@x"), (5, None, "namewrong", "right@x"),
    ]


def test_address_parts(spark):
    many(
        spark,
        [
            ("a@b.c", ("a", "b.c")),
            ('"x y"@b', ("x y", "b")),
            ("a(comment)@b(other)", ("a", "b")),
            ("alone", ("alone", "localhost")),
            ("a@", ("invalid", "invalid")),
            ("x" * 250 + "@long.example", ("invalid", "invalid")),
        ],
        lambda c: mail.address_parts(c),
    )


def test_dates(spark):
    def rule(c):
        d = dates.mail_date(c, F.lit("2023-05-01").cast("timestamp"))
        return F.concat_ws(" ", F.date_format(d["ts"], "yyyy-MM-dd HH:mm:ss"), d["zone_min"].cast("string"))

    many(
        spark,
        [
            ("Mon, 20 Jun 1982 10:11:12 +0200", "1982-06-20 08:11:12 120"),
            ("20 Jun 82 10:11", "1982-06-20 10:11:00 0"),
            ("20 Jun 05 10:11 EST", "2005-06-20 15:11:00 -300"),
            ("20 Jun 105 10:11 EDT", "2005-06-20 14:11:00 -240"),
            ("1 Aug 2020 00:00:00 A", "2020-08-01 01:00:00 -60"),
            ("1 Apr 2020 00:00:00 Y", "2020-03-31 12:00:00 720"),
            ("1 May 2020 00:00:00 PDT", "2020-05-01 07:00:00 -420"),
            ("1 Jul 2020", "2020-07-01 00:00:00 0"),
            ("1 Jul", "1970-07-01 00:00:00 0"),
            ("4 Jul 2020 01:02:03 GMT", "2020-07-04 01:02:03 0"),
            ("3 Mar 09:10:11 Z", "2023-03-03 09:10:11 0"),
            ("31 Feb 2021 00:00:00 +0000", "2021-03-03 00:00:00 0"),
            ("45 Jan 2021 25:61:00 Z", "2021-01-01 00:00:00 0"),
            ("", "1970-01-01 00:00:00 0"),
        ],
        rule,
    )


def test_http_dates(spark):
    many(
        spark,
        [
            ("01/Mar/2000 00:00:00", 951868800),
            ("31 Jan 2000 00:00:01", 949276801),
            ("Tue, 29 Feb 2000 12:00:00 GMT", 951825600),
            ("1-Jan-1971 00:00:00", 31536000),
            ("1 Jan 1970 00:00:00", 0),
            ("1 Foo 2000 00:00:00", 0),
            ("yesterday", 0),
        ],
        dates.http_date,
    )


def test_received(spark):
    text_ = (
        "noise from video.example (from inside) by mx (id none) via UUCP with SMTP with TLS id q1 "
        "for <a@b>; Mon, 1 Jan 2024 00:00:00 +0000"
    )
    r = one(spark, text_, mail.received)
    assert (r["from"], r["by"], r["via"], r["with"], r["id"], r["for"]) == (
        "video.example (from inside)", "mx (id none)", "UUCP", ["SMTP", "TLS"], "q1", "<a@b>",
    )
    assert one(spark, "from a by b", mail.received) is None


def test_ids(spark):
    many(
        spark,
        [
            ("<a@b>", "a@b"), ("(note <x@y>) <a@b>", "a@b"), ("  bare@id rest", "bare@id"), ("<left>", "left"),
            ("x \\< <a@b>", "a@b"),
        ],
        mail.message_id,
    )
    assert one(spark, "<a@b> <c@d>\r\n <e@f><g@h>", mail.message_ids) == ["a@b", "c@d", "e@f"]


def test_paths_and_importance(spark):
    many(spark, [("<a@b>", ("a", "b")), (" < a@b > ", ("a", "b")), ("<>", ("", "")), ("x", ("", "x"))], mail.return_path)
    cases = [("1", "low", "highest"), ("2 (high)", None, "high"), ("x", "high", "normal"), ("5", None, "lowest"),
             (None, "low", "lowest"), (None, " HIGH ", "highest"), (None, None, "normal"), ("9", None, "normal")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r["r"] for r in df.orderBy("i").select(mail.importance(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [c[2] for c in cases]


HEAD = "Content-Type: multipart/mixed; boundary={b}\r\n\r\n"
MULTIPART = {
    "plain": (HEAD.format(b="B") + "pro\r\n--B\r\n\r\none\r\n--B\r\n\r\ntwo\r\n--B--\r\nepi", ["one", "two"]),
    "no end": (HEAD.format(b="B") + "--B\r\n\r\none\r\n--B\r\n\r\ntwo", ["one", "two"]),
    "guessed": ("Content-Type: multipart/mixed\n\npro\n--xyz \n\none\n--xyz--\n", None),
    "guess": ("Content-Type: multipart/mixed\n\npro\n--xyz\n\none\n--xyz--\n", ["one"]),
    "prefix": (HEAD.format(b="B") + "--B\n\none\n--BB\n\nstill\n--B--", ["one\n--BB\n\nstill"]),
    "blanks": (HEAD.format(b="B") + "--  B\n\none\n-- B \nno\n--B--", ["one\n-- B \nno"]),
    "adjacent": (HEAD.format(b="B") + "--B\r\n--B\r\n\r\ntwo\r\n--B--", ["", "two"]),
    "regex": (HEAD.format(b='"a.b*(\\\\E)"') + "--a.b*(\\E)\n\none\n--a.b*(\\E)--", ["one"]),
}


@pytest.mark.parametrize("case", [k for k in MULTIPART if MULTIPART[k][1] is not None])
def test_multipart(spark, case):
    raw, want = MULTIPART[case]
    df = spark.createDataFrame([("k", raw)], "msg_key string, raw string")
    rows = bodies.explode_parts(df).filter("depth = 1").orderBy("part_path").collect()
    assert [r["body"] for r in rows] == want


def nested(depth):
    if depth == 0:
        return "Content-Type: text/plain\r\n\r\nleaf"
    b = f"b{depth}x"
    return f"Content-Type: multipart/mixed; boundary={b}\r\n\r\n--{b}\r\n{nested(depth - 1)}\r\n--{b}--\r\n"


def test_any_depth(spark):
    df = spark.createDataFrame([("k", nested(9)), ("f", nested(0))], "msg_key string, raw string")
    parts = bodies.explode_parts(df)
    assert "pending" not in parts.columns
    assert parts.filter("msg_key = 'k'").count() == 10
    leaf = parts.filter("type = 'text' and msg_key = 'k'").first()
    assert leaf["body"] == "leaf" and list(leaf["part_path"]) == [0] * 9
    assert parts.filter("msg_key = 'f'").count() == 1


def part_text(fields, body="x"):
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + body


@pytest.mark.parametrize(
    "fields, off, on",
    [
        ({"Content-Disposition": "attachment"}, True, True),
        ({"Content-Disposition": "inline", "Content-Type": "text/plain"}, True, False),
        ({"Content-Disposition": "inline", "Content-ID": "<a>", "Content-Type": "image/png"}, False, True),
        ({"Content-Type": "image/png"}, True, True),
        ({"Content-Type": "image/png", "Content-ID": "<a>"}, False, True),
        ({"Content-Type": "image/png; name=x", "Content-ID": "<a>"}, True, True),
        ({"Content-Type": "text/html"}, False, False),
        ({"X": "y"}, True, True),
        ({"Content-ID": "<a>"}, False, True),
    ],
)
def test_attachment_rules(spark, fields, off, on):
    raw = HEAD.format(b="B") + "--B\r\n" + part_text(fields) + "\r\n--B--"
    parts = bodies.explode_parts(spark.createDataFrame([("k", raw)], "msg_key string, raw string")).filter("depth = 1")
    assert bodies.attachments(parts).first()["is_attachment"] is off
    assert bodies.attachments(parts, inline=True).first()["is_attachment"] is on


def test_root_is_no_attachment(spark):
    for fields, want in [({"X": "y"}, False), ({"Content-Disposition": "inline"}, False), ({"Content-Type": "image/png"}, True)]:
        df = spark.createDataFrame([("k", part_text(fields))], "msg_key string, raw string")
        assert bodies.attachments(bodies.explode_parts(df)).first()["is_attachment"] is want


def test_attachment_hides_children(spark):
    inner = "Content-Type: multipart/mixed; boundary=I\r\nContent-Disposition: attachment\r\n\r\n--I\r\nContent-Type: image/png\r\n\r\nx\r\n--I--"
    raw = HEAD.format(b="B") + "--B\r\n" + inner + "\r\n--B--"
    parts = bodies.explode_parts(spark.createDataFrame([("k", raw)], "msg_key string, raw string"))
    assert [list(r["part_path"]) for r in bodies.attachment_inventory(parts).collect()] == [[0]]


def test_codecs(spark):
    def text_of(rule):
        return lambda c: rule(c).cast("string")

    many(
        spark,
        [("aGVs bG8=", "hello"), ("aGVs\r\nbG8=ignored", "hello"), ("aGVsb", "hel"), ("", ""), ("aGVsbG8", "hello")],
        text_of(codecs.base64_bytes),
    )
    many(
        spark,
        [("a=\r\nb=\nc", "abc"), ("=C3=A9", "é"), ("a_b", "a_b"), ("50=25", "50%"), ("bad=zz", "bad=zz"), ("=3D=", "=")],
        text_of(codecs.quoted_printable_bytes),
    )
    assert bytes(one(spark, "a_b=5F", lambda c: codecs.quoted_printable_bytes(c, header=True))) == b"a b_"
    uu = "begin 644 name\r\n#0V%T\r\n`\r\nend\r\n"
    assert bytes(one(spark, uu, codecs.uudecode)) == b"Cat"
    many(
        spark,
        [
            (".dot", "=2Edot"), ("a \r\nb\t=?", "a=20\r\nb=09=3D=3F"), ("50% +", "50% +"),
            ("x" * 80, "x" * 73 + "=\r\n" + "x" * 7), ("x" * 72 + "é", "x" * 72 + "=C3=\r\n=A9"),
            ("x" * 73 + "." + "y" * 71, "x" * 73 + "=\r\n=2E" + "y" * 70 + "=\r\ny"),
        ],
        lambda c: codecs.quoted_printable(c),
    )


def test_charsets(spark):
    rows = [("C3A9", "utf-8", "é"), ("E9", "ISO-8859-1", "é"), ("F0D2", "koi8-r", "Пр"), ("61C3", "utf-8", "a?"),
            ("1B2442467C1B2842", "iso-2022-jp", "日"), ("C3A9", "no-such", "é")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, h string, c string")
    out = bodies.to_utf8(df.withColumn("d", F.unhex("h")), "d", "c").orderBy("i").collect()
    assert [r["text"] for r in out] == [r[2] for r in rows]


def test_receipts(spark):
    def report(notice, kind="disposition-notification"):
        return (
            f'Content-Type: multipart/report; report-type={kind}; boundary="B"\r\n\r\n--B\r\n\r\nhuman\r\n--B\r\n'
            f"Content-Type: message/disposition-notification\r\n\r\n{notice}\r\n--B--"
        )

    rows = [
        ("a", report("Original-Message-ID: <m@x>\r\nDisposition: manual-action/MDN-sent-manually; displayed/error , warning\r\nReceived-content-MIC: abc, sha1")),
        ("b", report("Disposition: automatic-action; deleted")),
        ("c", report("Original-Message-ID: <m@x>", kind="delivery-status")),
    ]
    parts = bodies.explode_parts(spark.createDataFrame(rows, "msg_key string, raw string"))
    got = {r["msg_key"]: r for r in bodies.receipts(parts).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["original_id"], a["action_mode"], a["sending_mode"], a["type"], a["modifiers"], a["mic"]) == (
        "m@x", "manual-action", "MDN-sent-manually", "displayed", ["error", "warning"], "abc, sha1",
    )
    assert (b["original_id"], b["action_mode"], b["sending_mode"], b["type"], b["modifiers"]) == (
        None, "automatic-action", "", "deleted", [],
    )


def test_reply_codes(spark):
    many(
        spark,
        [
            ("250-a\r\n250 2.1.5 b\r\n", (250, "2.1.5", "a\n2.1.5 b")),
            ("250-a\n550 b", (0, "0.0.0", "a\nb")),
            ("354", (354, "0.0.0", "")),
        ],
        bodies.reply_codes,
    )


def test_flags_and_names(spark):
    many(
        spark,
        [("1.x:2,RS", ("1.x", 9)), ("1-2,f", ("1", 16)), ("plain", ("plain", 0)), ("a-b:2,TD", ("a-b", 68))],
        mailbox.file_id_flags,
    )
    many(
        spark,
        [("INBOX", "INBOX"), ("A&-B", "A&B"), ("&AOk-t&AOk-", "été"), ("&ZeVnLIqe-", "日本語")],
        codecs.folder_name_text,
    )
    assert one(spark, "été & 日本語", codecs.folder_name_encoded) == "&AOk-t&AOk- &- &ZeVnLIqe-"
    assert one(spark, ["\\Seen", "\\DRAFT", "\\other"], mailbox.keyword_flags, "array<string>") == 65


def test_folder_attributes(spark):
    rows = [(1, ["\\NoSelect", "\\HasChildren"]), (2, ["\\Sent", "\\Trash"]), (3, ["\\HasChildren", "\\NoInferiors"]), (4, [])]
    out = {r["k"]: r for r in mailbox.folder_attributes(spark.createDataFrame(rows, "k int, flags array<string>"), children_known=False).collect()}
    assert (out[1]["contains_messages"], out[1]["no_open"], out[1]["has_children"], out[1]["special_use"]) == (False, True, True, "none")
    assert out[2]["special_use"] == "trash" and out[3]["has_children"] is False and out[4]["has_children"] is True


def test_listing(spark):
    df = spark.createDataFrame([("  1 a b \r\n2\r\n1 again\r\nx y\n3\tz",)], "r string")
    got = sorted((r["number"], r["value"]) for r in nodes.parse_listing(df, "r").collect())
    assert got == [(0, "y"), (1, "a b "), (3, "z")]


def test_access_rules(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("10.0.1.1",), ("9.9.9.9",), ("bad",)], "ip string")

    def access(rules):
        return [r["access"] for r in weblog.ip_access(df, "ip", rules).orderBy("ip").collect()]

    # Order by text: 10.0.0.1, 10.0.1.1, 9.9.9.9, bad.
    assert access(None) == [1, 1, 1, 1]
    assert access("+10.0.0.0/8,-10.0.1.0/24") == [1, 0, 0, 0]
    assert access("-10.0.1.0/24,+10.0.0.0/8") == [1, 1, 0, 0]
    assert access("+10.0.0.5/24") == [0, 0, 0, 0]
    assert access("+0.0.0.0/0") [:3] == [1, 1, 1]
    assert access("10.0.0.0/8") == [-1, -1, -1, -1]


def test_globs(spark):
    cases = [
        ("/a/b.txt", "/*", 2), ("/a/b.txt", "/**", 8), ("/a/b.txt", "**.TXT$", 8), ("/a/b.txt", "/?/b", 4),
        ("/a/b.txt", "x|/a", 2), ("/a/b.txt", "x|y", -1), ("/a", "/a$", 2), ("/ab", "/a$", -1), ("ab", "", 0),
        ("/a/b/c", "/*/c", -1), ("/a/b/c", "/**/c", 6),
    ]
    for value, pattern, want in cases:
        assert one(spark, value, lambda c, p=pattern: urls.glob_length(c, p)) == want, (value, pattern)


def test_requests(spark):
    raw = " \r\nGET /a%20b//../c?x=1 HTTP/1.0\r\nHost: h\r\nX-Y:z: w\r\n\r\nbody: no"
    r = one(spark, raw, urls.request_fields)
    assert (r["method"], r["uri"], r["version"], r["query"]) == ("GET", "/a b/c", "1.0", "x=1")
    assert [tuple(h) for h in r["headers"]] == [("Host", "h"), ("X-Y", "z: w")]
    assert one(spark, "BREW / HTTP/1.1\r\n\r\n", urls.request_fields) is None


def test_access_log(spark):
    lines = [
        ('1.2.3.4 - - [01/Jan/2024:00:00:00 +0100] "GET /a b HTTP/1.1" 200 12 - -',),
        ('1.2.3.4 - joe [01/Jan/2024:00:00:00 +0000] "- - HTTP/1.0" 400 0 "r" "agent "x""',),
        ("nonsense",),
    ]
    rows = weblog.parse_access_log(spark.createDataFrame(lines, "l string"), "l").orderBy("status").collect()
    assert len(rows) == 2
    assert (rows[0]["uri"], rows[0]["user"], rows[0]["referer"], rows[0]["agent"]) == ("/a b", None, None, None)
    assert (rows[1]["user"], rows[1]["referer"], rows[1]["agent"]) == ("joe", "r", 'agent "x"')


def test_urls(spark):
    many(
        spark,
        [("a%20b%zz%4", "a b%zz%4"), ("a+b", "a+b"), ("%C3%A9", "é")],
        lambda c: urls.percent_decode(c),
    )
    assert one(spark, "a+b%2B", lambda c: urls.percent_decode(c, form=True)) == "a b+"
    assert one(spark, "a b/*é~", lambda c: urls.percent_encode(c)) == "a%20b%2f%2a%c3%a9~"
    assert one(spark, "a b/*é~", lambda c: urls.percent_encode(c, "mail")) == "a%20b%2F*%C3%A9%7E"
    assert one(spark, "a=1&b&a=2&c=%20&", urls.query_params) == {"b": "b", "a": "2", "c": " ", "": ""}
    u = one(spark, "HTTP://us%40er:pw@host:80/p%20q?x=1", urls.split_url)
    assert (u["scheme"], u["username"], u["password"], u["host"], u["port"], u["path"], u["query"]) == (
        "http", "us@er", "pw", "host", 80, "/p q", "x=1",
    )
    assert one(spark, "file:///home/x", urls.split_url)["path"] == "/home/x"
    assert one(spark, "http://h/", urls.split_url)["path"] == ""
    assert one(spark, "nope", urls.split_url)["error"] == "No protocol separator"
    assert one(spark, "http:///x", urls.split_url)["error"] == "No host specified"
    many(spark, [("//a", "/a"), ("/..//b/../c", "/b/c"), ("/a\\..\\b", "/a\\b"), ("/a..b", "/a..b")], urls.normalise_path)


def test_encoding_choice(spark):
    many(
        spark,
        [
            ("", "base64"), ("plain", "7bit"), ("x" * 79, "quoted-printable"), ("x" * 78, "7bit"),
            ("a\n.b", "quoted-printable"), (".b", "7bit"), ("éa", "base64"), ("é" + "a" * 9, "quoted-printable"),
            ("a\x7f" + "b" * 8, "quoted-printable"), ("x" * 32768, "quoted-printable"), ("line\n" * 9000, "7bit"),
        ],
        text.choose_encoding,
    )
    assert one(spark, "é", lambda c: text.choose_encoding(c, "ISO-8859-15")) == "quoted-printable"
    many(spark, [("é", "B"), ("éabc", "Q"), ("=?=?=?", "B"), ("", "Q")], text.choose_word_encoding)
    many(spark, [("a=b", True), ("a=?b", False), ("a=", False), ("é", False)], text.is_7bit)
    many(spark, [('"a\\"b"', 'a"b'), ('"', '"'), ("x", "x")], text.unquote)
    many(spark, [(".\r\na\n.b", "..\r\na\n..b"), (".a", ".a")], text.stuff_dots)
