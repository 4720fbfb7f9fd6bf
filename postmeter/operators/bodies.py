"""Message bodies: part trees, decoding, text parts, attachments, receipts.

A message is opened inside its row, in one pass with a stack of multiparts, and exploded
once. A part takes along what its operators need to know about its
ancestors, so no operator joins parts back to parts of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.functions import codecs, mail, text

# Text before each line that starts with two dashes, and from the last one on.
_AT_DASHES = r"(?<=\n)(?=--)"


def is_attachment(p, root: Column, inline: bool) -> Column:
    """Attachment test on a part's facts. With ``inline`` embedded objects count as well."""
    disposition, has_id, has_loc = p["disposition"], p["content_id"].isNotNull(), p["location"].isNotNull()
    by_type = (
        F.when(p["type"].isNull(), ~root)
        .when(p["type"].isin("text", "multipart"), F.lit(False))
        .when(p["has_name"], F.lit(True))
    )
    if inline:
        return F.when(disposition != "inline", F.lit(True)).otherwise(by_type.otherwise(F.lit(True)))
    # An object that is shown inside the message is not one, unless its type has a name.
    embedded = has_id & ~root & p["type"].isNull()
    rest = F.when(has_id, F.lit(False)).otherwise(F.lit(True))
    by_type = F.when(embedded, F.lit(False)).otherwise(by_type.otherwise(rest))
    inline_rule = F.when(has_id | has_loc, F.lit(False)).otherwise(~root)
    return F.when(disposition.isNull(), by_type).when(disposition != "inline", F.lit(True)).otherwise(inline_rule)


# Columns of a part.
PART_COLUMNS = [
    "part_path", "type", "subtype", "content_type", "disposition", "disposition_value", "encoding", "content_id",
    "location", "description", "has_name", "n_children", "hidden", "hidden_inline", "parent_kind", "grand_kind",
    "parent_type", "headers", "body", "prolog", "epilog",
]

# What a part takes along from the multiparts around it.
_FACTS = ["hidden", "hidden_inline", "parent_kind", "grand_kind", "parent_type"]
_FACT_TYPES = "hidden:boolean,hidden_inline:boolean,parent_kind:string,grand_kind:string,parent_type:string"
_PATH = "array<int>"
# Multiparts whose end has not been seen, outermost first; places where a part begins or a multipart
# ends; finished multiparts.
_OPEN = f"array<struct<boundary:string,path:{_PATH},kids:int,{_FACT_TYPES}>>"
_EVENTS = f"array<struct<ends:boolean,path:{_PATH},at:int,skip:int,pos:int,{_FACT_TYPES}>>"
_DONE = f"array<struct<path:{_PATH},kids:int,stop:int>>"


def _row() -> dict[str, Column]:
    return {c: F.col(c) for c in PART_COLUMNS}


def _first(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda f: F.lower(f["name"]) == name), F.lit(0))["value"]


def _disposition(value: Column) -> Column:
    return F.lower(text.trim_blanks(mail.main_value(value)))


def _subtype(main: Column) -> Column:
    return text.trim_blanks(F.regexp_extract(main, r"^[^/]*/(.*)$", 1))


def _without_first_line_end(t: Column) -> Column:
    return F.when(t.startswith("\r\n"), F.substr(t, F.lit(3))).when(t.startswith("\n"), F.substr(t, F.lit(2))).otherwise(t)


def _line_end(t: Column) -> Column:
    """Length of the line end that a text closes with."""
    return F.when(t.endswith("\r\n"), 2).when(t.endswith("\n"), 1).otherwise(0)


def _pushed(open_: Column, head: Column, path: Column, facts, following: Column) -> Column:
    """The stack with the part that has this header on top, if it is a multipart.

    Without a boundary parameter the first line with two dashes tells the boundary, unless it is
    that of a multipart around it.
    """

    def entry(fields: Column) -> Column:
        content_type = _first(fields, "content-type")
        main = F.lower(mail.main_value(content_type))
        part = {
            "type": F.lit("multipart"), "has_name": F.lit(False),
            "disposition": _disposition(_first(fields, "content-disposition")),
            "content_id": mail.message_id(_first(fields, "content-id")),
            "location": _first(fields, "content-location"),
        }
        root = F.size(path) == 0
        rest = F.ltrim(F.substr(following, F.lit(3)), F.lit(" \t"))
        around = F.exists(open_, lambda o: F.startswith(rest, o["boundary"]))
        guess = F.rtrim(F.regexp_extract(following, r"\A--[ \t\r\n]*([^\r\n]*)", 1), F.lit(" \t"))
        guess = F.when(F.char_length(guess).between(1, 99) & ~F.coalesce(around, F.lit(False)), guess)
        boundary = F.coalesce(mail.param(content_type, "boundary"), guess)
        new = F.struct(
            boundary.alias("boundary"), path.alias("path"), F.lit(0).alias("kids"),
            (facts["hidden"] | is_attachment(part, root, False)).alias("hidden"),
            (facts["hidden_inline"] | is_attachment(part, root, True)).alias("hidden_inline"),
            _subtype(main).alias("parent_kind"), facts["parent_kind"].alias("grand_kind"),
            content_type.alias("parent_type"),
        )
        return F.when(main.startswith("multipart/") & boundary.isNotNull(), F.concat(open_, F.array(new))).otherwise(open_)

    return F.when(F.rlike(head, F.lit("(?i)multipart/")), text.bound(mail.header_fields(head), entry)).otherwise(open_)


def _state(open_, events, done, head, path, facts, pos) -> Column:
    return F.struct(
        open_.cast(_OPEN).alias("open"), events.cast(_EVENTS).alias("events"), done.cast(_DONE).alias("done"),
        head.cast("string").alias("head"), path.cast(_PATH).alias("path"),
        F.struct(*[facts[f].alias(f) for f in _FACTS]).cast(f"struct<{_FACT_TYPES}>").alias("facts"), pos.cast("int").alias("pos"),
    )


def _event(ends: bool, path: Column, at: Column, skip: Column, pos: Column, facts) -> Column:
    return F.array(
        F.struct(
            F.lit(ends).alias("ends"), path.alias("path"), at.alias("at"), skip.cast("int").alias("skip"), pos.alias("pos"),
            *[facts[f].alias(f) for f in _FACTS],
        ).cast(_EVENTS[6:-1])
    )


def _with_header(open_, events, done, so_far, path, facts, at, pos) -> Column:
    """The state with the text of a new part, which goes on the stack as soon as its header has ended."""

    def split(m: Column) -> Column:
        ended = F.size(m) > 1
        following = F.get(F.col("__pieces"), at + 1)
        stack = F.when(ended, _pushed(open_, F.get(m, F.lit(0)), path, facts, following)).otherwise(open_)
        return _state(stack, events, done, F.when(~ended, so_far), path, facts, pos)

    return text.bound(mail.split_message(so_far), split)


def _finished(parts: Column, stop: Column) -> Column:
    return F.transform(parts, lambda o: F.struct(o["path"].alias("path"), o["kids"].alias("kids"), stop.alias("stop")).cast(_DONE[6:-1]))


def _step(state: Column, x: Column) -> Column:
    """One more line with two dashes: the outermost multipart that has it as its boundary goes on or ends."""
    piece, at = x["piece"], x["at"]
    pos = state["pos"] + F.char_length(piece)

    def matched(rest: Column) -> Column:
        def is_of(o: Column) -> Column:
            return F.startswith(rest, o["boundary"]) & F.substr(
                rest, F.char_length(o["boundary"]) + 1, F.lit(1)
            ).isin("\r", "\n", "-")

        level = F.array_position(F.transform(state["open"], is_of), F.lit(True)).cast("int")

        def on(n: Column) -> Column:
            o = F.get(state["open"], n - 1)
            # Dashes and blanks stand before the rest: as many bytes as characters, and bytes need no pass to count.
            skip = F.octet_length(piece) - F.octet_length(rest) + F.char_length(o["boundary"])
            ends = F.startswith(F.substr(rest, F.char_length(o["boundary"]) + 1, F.lit(2)), F.lit("--"))
            stop = state["pos"] - _line_end(F.get(F.col("__pieces"), at - 1))
            above = F.slice(state["open"], F.lit(1), n - 1)
            inner = F.slice(state["open"], n + 1, F.size(state["open"]))
            child = F.concat(o["path"], F.array(o["kids"]))
            counted = o.withField("kids", o["kids"] + 1)
            # It stays on the stack without a boundary, for what follows up to the next line above it is its epilog.
            closed = _state(
                F.concat(above, F.array(o.withField("boundary", F.lit(None).cast("string")))),
                F.concat(state["events"], _event(True, o["path"], at, skip + 2, state["pos"], o)),
                F.concat(state["done"], _finished(inner, stop)),
                F.lit(None), o["path"], o, pos,
            )
            begun = _with_header(
                F.concat(above, F.array(counted)),
                F.concat(state["events"], _event(False, child, at, skip, state["pos"], o)),
                F.concat(state["done"], _finished(inner, stop)),
                _without_first_line_end(F.substr(piece, skip + 1)), child, o, at, pos,
            )
            other = F.when(state["head"].isNull(), state.withField("pos", pos)).otherwise(
                _with_header(
                    state["open"], state["events"], state["done"], F.concat(state["head"], piece), state["path"], state["facts"], at, pos
                )
            )
            return F.when(n == 0, other).when(ends, closed).otherwise(begun)

        return text.bound(level, on)

    return text.bound(F.ltrim(F.substr(piece, F.lit(3)), F.lit(" \t")), matched)


def _folded() -> Column:
    """The events of a message in order, from one pass over ``__pieces`` with a stack of open multiparts."""
    none = {"hidden": F.lit(False), "hidden_inline": F.lit(False), **{f: F.lit(None).cast("string") for f in _FACTS[2:]}}
    top, zero, empty = F.array().cast(_PATH), F.lit(0), lambda kind: F.array().cast(kind)
    first = F.get(F.col("__pieces"), zero)
    start = _with_header(empty(_OPEN), _event(False, top, zero, zero, zero, none), empty(_DONE), first, top, none, zero, F.char_length(first))
    numbered = F.transform("__pieces", lambda p, i: F.struct(p.alias("piece"), i.alias("at")))
    return F.aggregate(F.slice(numbered, F.lit(2), F.size("__pieces")), start, _step)


def _parts() -> Column:
    """The begun parts with their texts, the number of their children and what follows their closing line."""
    pieces, state = F.col("__pieces"), F.col("__state")
    all_done = F.concat(state["done"], _finished(state["open"], state["pos"]))
    count = F.size(state["events"])

    def texts(e: Column, i: Column) -> Column:
        following = F.get(state["events"], i + 1)["at"]
        own = F.array_join(F.slice(pieces, e["at"] + 1, F.coalesce(following, F.size(pieces)) - e["at"]), "")
        own = F.substr(own, e["skip"] + 1)
        cut = F.when(i + 1 < count, F.substr(own, F.lit(1), F.char_length(own) - _line_end(own))).otherwise(own)
        return e.withField("raw", cut)

    def whole(events: Column) -> Column:
        return F.transform(
            F.filter(events, lambda e: ~e["ends"]),
            lambda e: text.bound(
                F.get(F.filter(all_done, lambda d: d["path"] == e["path"]), F.lit(0)),
                lambda d: F.struct(
                    e["path"].alias("part_path"), *[e[f].alias(f) for f in _FACTS], F.coalesce(d["kids"], F.lit(0)).alias("n_children"),
                    F.when(e["at"] == 0, e["raw"]).otherwise(_without_first_line_end(e["raw"])).alias("raw"),
                    F.when(d.isNotNull(), F.regexp_replace(
                        F.get(F.filter(events, lambda x: x["ends"] & (x["path"] == e["path"])), F.lit(0))["raw"],
                        r"\A[ \t]*\r?\n", "",
                    )).alias("epilog"),
                    # Of a multipart: where its header begins and its last child or epilog ends.
                    (d["stop"] - e["pos"] - e["skip"] - F.when(e["at"] == 0, 0).otherwise(
                        F.char_length(e["raw"]) - F.char_length(_without_first_line_end(e["raw"]))
                    )).alias("extent"),
                ),
            ),
        )

    return text.bound(F.transform(state["events"], texts), whole)


def _parsed() -> list[dict[str, Column]]:
    """The projections that give a part its columns; each step uses the columns of the one before."""
    first = lambda name: mail.header_first("headers", name)
    main = F.lower(mail.main_value(F.col("content_type")))
    name_given = F.rlike("content_type", F.lit(r";\s*name\*?[0-9]*\*?\s*="))
    own = F.coalesce(F.get("__m", F.lit(1)), F.lit(""))
    opened = F.col("n_children") > 0
    return [
        {"__m": mail.split_message(F.col("raw"))},
        {
            "headers": mail.header_fields(F.get("__m", F.lit(0))),
            "body": F.when(~opened, own),
            "prolog": F.when(opened, own),
            "size": F.when(opened, F.col("extent") - F.char_length("raw") + F.char_length(own)).otherwise(F.char_length(own)),
        },
        {
            "content_type": first("content-type"),
            "disposition_value": first("content-disposition"),
            "encoding": F.lower(mail.main_value(first("content-transfer-encoding"))),
            "content_id": mail.message_id(first("content-id")),
            "location": mail.unfold(first("content-location")),
            "description": mail.unfold(first("content-description")),
        },
        {
            "type": text.trim_blanks(F.regexp_extract(main, r"^([^/]*)", 1)),
            "subtype": _subtype(main),
            "disposition": _disposition(F.col("disposition_value")),
            "has_name": F.coalesce(name_given, F.lit(False)),
        },
    ]


def explode_parts(messages: DataFrame) -> DataFrame:
    """One row per part of each message, at any depth, the message itself being the part with an empty path.

    A message is cut at its lines with two dashes, and one pass over them with a stack of the open
    multiparts gives all parts: nothing is parsed twice and nothing is stored. A line belongs to the
    outermost multipart that has it as its boundary. A multipart with children has no body of its
    own, but the text before the first and behind the last of them, ``prolog`` and ``epilog``; its
    ``size`` is that of all it holds.
    """
    keep = [c for c in messages.columns if c != "raw"]
    rows = messages.select(*keep, F.split(text.octets(F.col("raw")), _AT_DASHES).alias("__pieces"))
    rows = rows.withColumn("__state", _folded()).select(*keep, F.inline(_parts()))
    for step in _parsed():
        rows = rows.withColumns(step)
    rows = rows.select(*keep, F.size("part_path").alias("depth"), *PART_COLUMNS, "size")
    return text.settled(rows, ["depth", *PART_COLUMNS, "size"])


def part_tree(parts: DataFrame) -> DataFrame:
    """Tree facts per part; all of them are known from the pass that opened the tree."""
    return parts.select(
        "msg_key", "part_path", "depth", "n_children", "size",
        F.when(F.col("depth") > 0, F.slice("part_path", 1, F.col("depth") - 1)).alias("parent_path"),
    )


def media_type(parts: DataFrame, attachment: bool = False) -> DataFrame:
    """Type and subtype with the default of a body, or of an attachment."""
    default = ("application", "octet-stream") if attachment else ("text", "plain")
    return parts.withColumns(
        {
            "type": F.coalesce("type", F.lit(default[0])),
            "subtype": F.when(F.col("type").isNull(), F.lit(default[1])).otherwise(F.col("subtype")),
        }
    )


def decode_parts(parts: DataFrame, uuencode: bool = False) -> DataFrame:
    """Add ``content``: the decoded bytes of parts without children; unknown encodings give null.

    Python only sees uuencoded bodies, and only when asked to.
    """
    name = codecs.encoding_name(F.col("encoding"))
    leaf = F.col("n_children") == 0
    native = F.when(leaf, codecs.transfer_bytes(F.col("body"), name))
    if not uuencode:
        return parts.withColumn("content", native)
    is_uu = leaf & (name == "uuencode")
    return (
        parts.withColumn("__uu", codecs.uudecode(F.when(is_uu, F.col("body"))))
        .withColumn("content", F.coalesce("__uu", native))
        .drop("__uu")
    )


def encode_parts(df: DataFrame, col: str, encoding: str = "encoding") -> DataFrame:
    """Replace a text column by its transfer encoding."""
    from postmeter.operators.compose import encoded_body

    return df.withColumn(col, encoded_body(F.col(col), F.col(encoding)))


def charset_of(content_type: Column) -> Column:
    return F.lower(F.coalesce(mail.param(content_type, "charset"), F.lit("us-ascii")))


def to_utf8(df: DataFrame, data: str, charset: str, out: str = "text") -> DataFrame:
    """Bytes to text by a charset column, any charset."""
    return df.withColumn(out, codecs.text_of(F.col(data), F.col(charset), rare=True))


def attachments(parts: DataFrame, inline: bool = False) -> DataFrame:
    """Add ``is_attachment``."""
    return parts.withColumn("is_attachment", is_attachment(_row(), F.col("depth") == 0, inline))


def attachment_inventory(parts: DataFrame, inline: bool = False) -> DataFrame:
    """Attachments not inside another one: name, description, type, encoded size, nested message flag.

    The decoded ``content`` comes along where the parts have it.
    """
    tested = attachments(parts, inline)
    hidden = F.col("hidden_inline" if inline else "hidden")
    kept = media_type(tested.filter(F.col("is_attachment") & ~hidden), attachment=True)
    by_disposition = F.try_element_at(mail.header_params(F.col("disposition_value")), F.lit("filename"))
    by_type = F.try_element_at(mail.header_params(F.col("content_type")), F.lit("name"))
    return kept.select(
        "msg_key", "part_path",
        F.coalesce(by_disposition, by_type).alias("name"),
        "description", "type", "subtype", "size",
        ((F.col("type") == "message") & (F.col("subtype") == "rfc822")).alias("is_message"),
        *[c for c in ("content",) if c in parts.columns],
    )


def is_text_part() -> Column:
    """Texts of a message: its root where that is its only part, else the inline text children."""
    alone = (F.col("depth") == 0) & (F.col("n_children") == 0)
    typed_text = F.col("type") == "text"
    child = (F.col("depth") > 0) & typed_text & (F.coalesce("disposition", F.lit("inline")) == "inline")
    return (alone & (typed_text | F.col("type").isNull())) | child


def text_parts(parts: DataFrame) -> DataFrame:
    """Plain and html texts: the root of a message of one part, else the inline text children."""
    subtype = F.when(F.col("type").isNull(), F.lit("plain")).otherwise(F.col("subtype"))
    return parts.filter(is_text_part()).withColumn(
        "kind", subtype
    ).filter(F.col("kind").isin("plain", "html"))


def _with_objects(parts: DataFrame, keep: list[str]) -> DataFrame:
    """``msg_key, texts, objects``: the decoded html texts of a message and its parts that have a content id or location.

    Both are rows of the same parse, so a message is opened once and its rows meet in one exchange.
    """
    html = F.col("__kind") == "html"
    content = F.decode(codecs.transfer_bytes(F.col("body"), codecs.encoding_name(F.col("encoding"))), "ISO-8859-1")
    octet = lambda c: F.decode(F.col(c).cast("binary"), "ISO-8859-1")
    kind = F.when(is_text_part(), F.when(F.col("type").isNull(), "plain").otherwise(F.col("subtype")))
    rows = parts.withColumn("__kind", kind).select(
        "msg_key",
        F.when(html, F.struct(F.col("part_path").alias("path"), content.alias("html"))).alias("t"),
        F.when(
            F.col("content_id").isNotNull() | F.col("location").isNotNull(),
            F.struct(*keep, octet("content_id").alias("id_octets"), octet("location").alias("location_octets")),
        ).alias("o"),
    )
    found = text.settled(rows, ["t", "o"]).filter("t is not null or o is not null")
    return found.groupBy("msg_key").agg(F.collect_list("t").alias("texts"), F.collect_list("o").alias("objects"))


def _shown_by_id(html: Column, o: Column) -> Column:
    return F.contains(html, F.concat(F.lit("cid:"), o["id_octets"])) | F.contains(html, F.concat(F.lit("CID:"), o["id_octets"]))


def _shown_by_location(html: Column, o: Column) -> Column:
    return F.contains(html, o["location_octets"])


def embedded_objects(parts: DataFrame) -> DataFrame:
    """Html parts with the parts they show, by content id or by location.

    An object matches when the html holds ``cid:`` and its id, or its location,
    anywhere; both rules can list the same object. Pairs form within a message only.
    """
    rows = _with_objects(parts, ["part_path", "content_id", "location"]).filter("msg_key is not null")

    def pairs(t: Column) -> Column:
        def rules(o: Column) -> Column:
            pair = lambda rule, ref: F.struct(
                t["path"].alias("html_path"), o["part_path"].alias("object_path"), F.lit(rule).alias("rule"), ref.alias("ref")
            )
            return F.array_compact(
                F.array(
                    F.when(_shown_by_id(t["html"], o), pair("id", o["content_id"])),
                    F.when(_shown_by_location(t["html"], o), pair("location", o["location"])),
                )
            )

        return F.flatten(F.transform(F.filter("objects", lambda o: F.size(o["part_path"]) > 0), rules))

    return rows.select("msg_key", F.inline(F.flatten(F.transform("texts", pairs))))


def object_coverage(parts: DataFrame) -> DataFrame:
    """Parts with a content id, ``msg_key, part_path, subtype``, and whether an html part of their message shows them."""

    def shown(o: Column) -> Column:
        by_any = F.exists(
            "texts", lambda t: F.coalesce(_shown_by_id(t["html"], o), F.lit(False)) | F.coalesce(_shown_by_location(t["html"], o), F.lit(False))
        )
        return F.col("msg_key").isNotNull() & (F.size(o["part_path"]) > 0) & by_any

    named = F.filter("objects", lambda o: o["content_id"].isNotNull())
    listed = F.transform(named, lambda o: F.struct(o["part_path"].alias("part_path"), o["subtype"].alias("subtype"), shown(o).alias("shown")))
    return _with_objects(parts, ["part_path", "subtype", "content_id"]).select("msg_key", F.inline(listed))


def plain_alternative(parts: DataFrame) -> DataFrame:
    """Html parts with the path of their plain text: the first plain child of the alternative above."""
    up = F.when(F.col("grand_kind") == "alternative", 2).when(F.col("parent_kind") == "alternative", 1)
    html = (
        text_parts(parts)
        .filter("kind = 'html'")
        .select("msg_key", F.col("part_path").alias("html_path"), F.slice("part_path", 1, F.col("depth") - up).alias("alt_path"))
    )
    plain = (
        parts.filter("parent_kind = 'alternative' and type = 'text' and subtype = 'plain'")
        .groupBy("msg_key", F.slice("part_path", 1, F.col("depth") - 1).alias("alt_path"))
        .agg(F.min_by("part_path", F.element_at("part_path", -1)).alias("plain_path"))
    )
    return html.join(plain, ["msg_key", "alt_path"], "left").select("msg_key", "html_path", "plain_path")


def digests(df: DataFrame, col: str) -> DataFrame:
    data = F.col(col).cast("binary")
    return df.withColumns({"md5": F.md5(data), "sha1": F.sha1(data)})


def duplicates(df: DataFrame, col: str, key: str) -> DataFrame:
    """Groups of equal content: size and first key. Counts are merged before the shuffle."""
    return (
        digests(df, col)
        .groupBy("sha1")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .filter("copies > 1")
    )


def receipt_requests(messages: DataFrame) -> DataFrame:
    """Each address that asks for a receipt, and whether the user must confirm."""
    from postmeter.operators.headers import with_headers

    h = "headers"
    keep = [c for c in messages.columns if c != "raw"]
    asked = F.transform(
        mail.address_list(mail.header_first(h, "disposition-notification-to")), lambda a: mail.mailbox(a["address"])
    )
    path = mail.return_path(mail.header_first(h, "return-path"))
    rows = with_headers(messages).select(*keep, asked.alias("asked"), path.alias("path"))
    sender = F.concat("path.local", F.lit("@"), "path.domain")
    confirm = (
        F.col("path").isNull()
        | (F.size("asked") > 1)
        | (F.get("asked", F.lit(0))["address"] != sender)
    )
    return rows.filter(F.size("asked") > 0).select(*keep, confirm.alias("confirm"), F.explode("asked").alias("m")).select(
        *keep, "confirm", F.col("m.address").alias("address")
    )


def receipts(parts: DataFrame) -> DataFrame:
    """Receipt messages: original id, disposition and digest from the notification part."""
    # A part knows the Content-Type of its parent, so the report needs no join.
    in_report = (F.col("parent_kind") == "report") & (
        mail.param(F.col("parent_type"), "report-type") == "disposition-notification"
    )
    notices = parts.filter("depth = 1 and type = 'message' and subtype = 'disposition-notification'").filter(in_report)
    content = codecs.transfer_bytes(F.col("body"), codecs.encoding_name(F.col("encoding")))
    fields = mail.header_fields(F.get(mail.split_message(F.decode(content, "ISO-8859-1")), F.lit(0)))
    rows = text.settled(notices.select("msg_key", "part_path", fields.alias("f")), ["f"])
    rows = rows.withColumn("__d", mail.receipt_disposition(mail.header_first("f", "disposition")))
    read = rows.select(
        "msg_key", "part_path",
        mail.message_id(mail.header_first("f", "original-message-id")).alias("original_id"),
        "__d.action_mode", "__d.sending_mode", "__d.type", "__d.modifiers",
        mail.header_first("f", "received-content-mic").alias("mic"),
    )
    return text.settled(read, ["original_id"])


def receipt_rate(receipts: DataFrame, sent: DataFrame, by: str) -> DataFrame:
    """Messages sent and messages with a receipt, per value of ``by``. ``sent`` has ``id`` and ``by``."""
    answered = receipts.groupBy(F.col("original_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return sent.join(answered, "id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("sent"), F.count("n").alias("answered")
    )


_CODE = r"^([0-9]{3})"


def reply_codes(reply: Column) -> Column:
    """``struct(code, enhanced, text)`` of a server reply of one or more lines."""
    lines = F.split(F.regexp_replace(reply, r"(?:\r?\n)+\z", ""), r"\r?\n")
    codes = F.transform(lines, lambda s: F.coalesce(F.regexp_extract(s, _CODE, 1).try_cast("int"), F.lit(0)))
    texts = F.transform(lines, lambda s: text.trim_blanks(F.substr(s, F.lit(5))))
    enhanced = F.regexp_extract(F.element_at(texts, -1), r"^([0-9]+\.[0-9]+\.[0-9]+)", 1)
    return F.struct(
        F.when(F.size(F.array_distinct(codes)) == 1, F.get(codes, F.lit(0))).otherwise(0).alias("code"),
        F.when(enhanced == "", "0.0.0").otherwise(enhanced).alias("enhanced"),
        F.array_join(texts, "\n").alias("text"),
    )


def delivery_codes(df: DataFrame, col: str = "reply") -> DataFrame:
    return df.withColumn("__r", reply_codes(F.col(col))).select(*df.columns, "__r.code", "__r.enhanced", "__r.text")


def text_quality(df: DataFrame, col: str) -> DataFrame:
    """Size, ASCII share and form of a text column."""
    c = F.col(col)
    size = F.octet_length(c)
    return df.withColumns(
        {
            "bytes": size,
            "ascii": text.counted_ascii(c),
            "is_7bit": text.is_7bit(c),
            "trimmed": F.char_length(text.trim_blanks(c)),
            "quoted": F.char_length(text.quote(c)),
        }
    )


def utf8_quality(df: DataFrame, col: str) -> DataFrame:
    """Validity, byte order mark, repaired text and its length in code points."""
    c = F.col(col)
    return df.withColumns(
        {
            "valid": text.utf8_valid(c),
            "bom": text.has_bom(c),
            "repaired": text.utf8_repaired(c),
            "code_points": F.char_length(text.utf8_repaired(c)),
        }
    )


def normalise_lines(df: DataFrame, col: str, mode: str) -> DataFrame:
    """``crlf``, ``lf``, ``stuff`` or ``unstuff``."""
    rule = {"crlf": text.to_crlf, "lf": text.to_lf, "stuff": text.stuff_dots, "unstuff": text.unstuff_dots}[mode]
    return df.withColumn(col, rule(F.col(col)))
