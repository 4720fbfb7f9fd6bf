"""Chat formatting: a finite-state machine over roles and text segments with loss flags.

A template is data: the transitions of the machine, its final states, and for each role the
segments of a turn, each with a flag that says whether a model is trained on it. Turns go through
the machine in order; each gives its segments, so that a formatted conversation is the
concatenation of its rows. A row that the machine refuses is formatted all the same and marked.

Texts may hold anything, control strings included: ``<|`` is written as ``<\\|``, with one more
backslash than it had, so no text can hold a control string and reading back loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns from which on a conversation is cut into slices, each a group of its own.
SLICE_TURNS = 4096
#: No more than one in so many rows makes a conversation long, so the list of long ones is bounded.
LONG_SHARE = 2000

START, REFUSED = "start", "refused"


@dataclass(frozen=True)
class Template:
    """``turns[role]`` are the ``(text, loss)`` segments of a turn; ``*`` stands for all other roles.

    ``{role}`` and ``{text}`` are filled in, escaped. A segment of more than ``{text}`` belongs to
    the template and is never part of a text. ``steps[state][role]`` is the next state; what is
    not listed is refused, and the machine goes on from the state named after the role, if any.
    """

    steps: dict[str, dict[str, str]]
    final: tuple[str, ...]
    turns: dict[str, tuple[tuple[str, bool], ...]]
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        names = [START, *self.steps, *(s for out in self.steps.values() for s in out.values()), REFUSED]
        object.__setattr__(self, "states", tuple(dict.fromkeys(names)))

    def segments(self, role: str) -> tuple[tuple[str, bool], ...]:
        return self.turns.get(role, self.turns["*"])

    def step(self, state: int, role: str) -> tuple[int, bool]:
        """The next state and whether the machine accepts the turn."""
        to = self.steps.get(self.states[state], {}).get(role)
        if to is not None:
            return self.states.index(to), True
        return self.states.index(role if role in self.steps else REFUSED), False


def _turn(loss: bool) -> tuple[tuple[str, bool], ...]:
    return (("<|im_start|>{role}\n", False), ("{text}", loss), ("<|im_end|>\n", False))


CHAT = Template(
    steps={
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    },
    final=("assistant",),
    turns={"assistant": _turn(True), "*": _turn(False)},
)

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def written(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """The segments of a turn."""
    filled = {"role": escape_role(role), "text": escape(text)}
    return [(re.sub(r"\{(role|text)\}", lambda m: filled[m[1]], s), loss) for s, loss in template.segments(role)]


def read_turn(segments: list[tuple[str, bool]], template: Template) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) of a written turn; what is no turn raises an error."""
    whole = "".join(s for s, _ in segments)
    opening, closing = template.opening, template.closing
    head, end = whole.find("\n"), whole.find(closing)
    if not whole.startswith(opening) or whole.count(opening) != 1 or not 0 < head < end or whole[end:] != closing + "\n":
        raise ValueError(f"not a turn: {whole[:80]!r}")
    return (
        unescape_role(whole[len(opening) : head]),
        unescape(whole[head + 1 : end]),
        unescape("".join(s for s, loss in segments if loss)),
    )


def _long(conversations: DataFrame, key: str, share: int, slice_turns: int) -> list:
    """Keys of conversations that hold more rows than a slice and more than one row in ``share``.

    There are at most ``share`` of them, whatever the table.
    """
    sizes = conversations.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = conversations.count()
    return [r.k for r in sizes.filter(F.col("n") > max(slice_turns, -(-total // share))).select("k").collect()]


def _in(key: str, keys: list) -> Column:
    known = [k for k in keys if k is not None]
    held = F.col(key).isin(known) if known else F.lit(False)
    return F.coalesce(held, F.lit(False)) | (F.col(key).isNull() & F.lit(None in keys))


def _walk(template: Template, numbered: bool) -> callable:
    """Turns in order to rows; a change of (key, slice) starts the machine anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = None, 0, 0
        for batch in batches:
            names = ("k", "s", "at", "turn", "role", "text")
            k, s, at, turn, role, text = (batch.column(c).to_pylist() for c in names)
            numbers, out, states, accepted = [], [], [], []
            for i in range(len(k)):
                if (k[i], s[i]) != last:
                    last, n = (k[i], s[i]), 0
                    state = (at[i] or 0) if numbered else 0
                who = role[i] or ""
                state, fits = template.step(state, who)
                numbers.append(n)
                out.append([{"text": t, "loss": f} for t, f in written(who, text[i] or "", template)])
                states.append(template.states[state])
                accepted.append(fits)
                n += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), batch.column("s"), pa.array(numbers, pa.int64()), batch.column("turn"), batch.column("role"),
                    pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
                    pa.array(states, pa.string()), pa.array(accepted, pa.bool_()),
                ],
                ["k", "s", "n", "turn", "role", "segments", "state", "accepted"],
            )

    return run


def _effects(template: Template) -> callable:
    """For each slice, the state that it leads to from every state: slices are composed from that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            (k, s), to = held["id"], held["to"]
            return pa.RecordBatch.from_arrays(
                [pa.array([k], kind), pa.array([s], pa.int64()), pa.array([to], pa.list_(pa.int32()))], ["k", "s", "to"]
            )

        for batch in batches:
            kind = batch.column("k").type
            for k, s, role in zip(*(batch.column(c).to_pylist() for c in ("k", "s", "role")), strict=True):
                if held.get("id") != (k, s):
                    if held:
                        yield out()
                    held.update(id=(k, s), to=list(range(len(template.states))))
                held["to"] = [template.step(x, role or "")[0] for x in held["to"]]
        if held:
            yield out()

    return run


_ROW = "s long, n long, turn {turn}, role string, segments array<struct<text: string, loss: boolean>>, state string, accepted boolean"
_ORDER = ("k", "s", "turn", "role", "text")


def format_turns(
    conversations: DataFrame, template: Template = CHAT, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", slice_turns: int = SLICE_TURNS, share: int = LONG_SHARE,
) -> tuple[DataFrame, list]:
    """One row per turn: key, turn, role, ``segments(text, loss)``, ``state`` and ``accepted``; and the long keys.

    ``state`` is the machine's after the turn; a conversation is valid if all turns are accepted
    and complete if its last state is final. Rows lie in order within a partition, a conversation
    in one piece; one of more turns than a slice and than one row in ``share`` lies in slices
    ``s`` instead, each with its rows numbered ``n``. States do not depend on that: slices are
    composed from where each leads from every state.

    Null texts and roles are empty. Rows of one turn are ordered by role and text, repeated rows
    stay, null turns come first, null keys are one conversation. An empty table gives no rows.
    Other columns are left out, whatever their names.
    """
    kinds = dict(conversations.dtypes)
    long = _long(conversations, key, share, slice_turns)
    rows = conversations.select(
        F.col(key).alias("k"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text")
    )
    schema = f"k {kinds[key]}, " + _ROW.format(turn=kinds[turn])

    def walked(df: DataFrame, numbered: bool) -> DataFrame:
        order = [F.col(c) for c in _ORDER]
        dealt = df.repartition("k", "s").sortWithinPartitions(*order)
        return dealt.mapInArrow(_walk(template, numbered), schema)

    is_long = _in("k", long)
    usual = rows.filter(~is_long) if long else rows
    found = walked(usual.select("*", F.lit(0).cast("long").alias("s"), F.lit(0).alias("at")), False)
    if long:
        cut = rows.filter(is_long).withColumn("s", F.floor(F.col("turn") / slice_turns).cast("long"))
        effects = (
            cut.select("k", "s", "turn", "role").repartition("k", "s").sortWithinPartitions("k", "s", "turn", "role")
            .mapInArrow(_effects(template), f"k {kinds[key]}, s long, to array<int>")
        )
        chain = effects.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "to"))).alias("c"))
        starts = chain.select("k", F.posexplode("c").alias("i", "x"), "c").select(
            "k", F.col("x.s").alias("s"),
            F.aggregate(F.slice("c", 1, F.col("i")), F.lit(0), lambda at, x: F.get(x["to"], at)).alias("at"),
        )
        here = starts.select(F.col("k").alias("k2"), F.col("s").alias("s2"), "at")
        joined = cut.join(here, F.col("k").eqNullSafe(F.col("k2")) & F.col("s").eqNullSafe(F.col("s2")), "left")
        found = found.unionByName(walked(joined.select(*rows.columns, "s", "at"), True))
    return found.withColumnsRenamed({"k": key}), long


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True


def digests(formatted: DataFrame, long: list, template: Template = CHAT, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its segments: counts and digests of turns and of text under the loss mask.

    Conversations in one piece are read where they lie. The slices of a long one are brought
    together in order and streamed, as a digest has to see all of it one after the other; no
    more than a batch is held.
    """
    kind = dict(formatted.dtypes)[key]
    names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        ktype = None

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in done], ktype),
                    pa.array([d.n for _, d in done], pa.int64()), pa.array([d.turns.hexdigest() for _, d in done]),
                    pa.array([d.loss_chars for _, d in done], pa.int64()), pa.array([d.loss.hexdigest() for _, d in done]),
                    pa.array([d.chars for _, d in done], pa.int64()), pa.array([d.valid for _, d in done], pa.bool_()),
                ],
                names,
            )

        for batch in batches:
            ktype = batch.column(0).type
            done = []
            for k, segments, fits in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                if not held or held["k"] != k:
                    if held:
                        done.append((held["k"], held["d"]))
                    held.update(k=k, d=_Digest())
                d = held["d"]
                pairs = [(s["text"], s["loss"]) for s in segments]
                role, text, loss = read_turn(pairs, template)
                d.n += 1
                d.turns.update(f"{role}\n{text}\n".encode())
                d.loss.update(loss.encode())
                d.loss_chars += len(loss)
                d.chars += sum(len(s) for s, _ in pairs)
                d.valid = d.valid and fits
            if done:
                yield out(done)
        if held:
            yield out([(held["k"], held["d"])])

    schema = (
        f"k {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )

    def read(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("k"), "segments", "accepted").mapInArrow(run, schema)

    if not long:
        return read(formatted).withColumnRenamed("k", key)
    is_long = _in(key, long)
    whole = formatted.filter(is_long).repartition(key).sortWithinPartitions(key, "s", "n")
    return read(formatted.filter(~is_long)).unionByName(read(whole)).withColumnRenamed("k", key)
