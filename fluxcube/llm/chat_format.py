"""Chat formatting: a declarative template, a finite-state machine over roles, and loss flags for each text segment.

All of it is DataFrame functions: one aggregation by conversation, then higher-order functions on its turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which roles may follow one another, and whose text is learned.

    No prefix or suffix survives in an escaped text: each holds one of the characters that `escapes` replaces. Escapes
    start with a backslash, which is escaped itself, so they are undone by plain replacements, the backslash last.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    after_label: str = ": "
    closing: str = "</turn>\n"
    unknown_mark: str = "="
    learned: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    #: state -> roles that may follow; a state is the role of the last turn
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        for plain, coded in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(coded))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, coded in reversed(self.escapes):
            text = F.replace(text, F.lit(coded), F.lit(plain))
        return text

    def label(self, role: Column) -> Column:
        out = F.concat(F.lit(self.unknown_mark), self.escape(role))
        for name, label in self.labels.items():
            out = F.when(role == name, label).otherwise(out)
        return out

    def role(self, label: Column) -> Column:
        out = self.unescape(F.substring(label, len(self.unknown_mark) + 1, 1 << 30))
        for name, known in self.labels.items():
            out = F.when(label == known, name).otherwise(out)
        return out

    def step(self, state: Column, role: Column) -> Column:
        """The transition table. Once a role comes that may not follow, states keep the role and a mark, for good."""
        table = F.create_map(*[F.lit(x) for s, allowed in self.follows.items() for r in allowed for x in (f"{s}>{r}", r)])
        known = F.when(role.isin(*self.labels), role).otherwise("?")
        return F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)), F.concat(F.lit(BROKEN), known))

    def states(self, roles: Column) -> Column:
        """The machine's state after each of `roles`. Blocks of states are appended to, so that long conversations don't copy
        all of them for each turn."""
        run = lambda block, state: F.aggregate(block, F.array(state), lambda path, role: F.concat(path, F.array(self.step(F.element_at(path, -1), role))))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(roles) - 1) / BLOCK).cast("int")), lambda k: F.slice(roles, k * BLOCK + 1, F.lit(BLOCK)))
        done = F.aggregate(
            blocks,
            F.array(F.array(F.lit("start"))),
            lambda paths, block: F.concat(paths, F.array(F.slice(run(block, F.element_at(F.element_at(paths, -1), -1)), F.lit(2), F.lit(BLOCK)))),
        )
        return F.flatten(F.slice(done, F.lit(2), F.size(done)))

    def loss(self, state: Column) -> Column:
        """What a state emits: 1 if the text of its turn is learned."""
        flags = F.create_map(*[F.lit(x) for r in self.labels for mark in ("", BROKEN) for x in (mark + r, int(r in self.learned))])
        return F.coalesce(F.try_element_at(flags, state), F.lit(0))


#: Marks the states of a conversation whose order is not allowed.
BROKEN = "!"
BLOCK = 64
DEFAULT = ChatTemplate()


def format_chats(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """`turns(conv_id, turn, role, text, ...)` -> `conv_id, n_turns, valid, state, segments, formatted`.

    `segments` is an array of `(text, loss)` that concatenates to `formatted`; a text's loss is what the machine's state after
    its turn emits: 1 for learned roles; markers have 0. Turns are ordered by turn, ties by role and text; null turns come first. Null texts and
    roles count as empty; a role the template does not know is written with a mark and makes the conversation invalid,
    as does any order of roles that the machine doesn't allow. Invalid conversations are formatted all the same, for the
    caller to drop. Repeated rows are repeated turns; null conversation ids form one conversation. Other columns are
    not read. One conversation must fit a row, since its output is one string.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    by_conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("t"))
    by_conv = by_conv.withColumn("path", template.states(F.transform("t", lambda t: t["role"])))
    marker = lambda text: F.struct(text.alias("text"), F.lit(0).alias("loss"))
    segments = F.flatten(
        F.zip_with(
            "t",
            "path",
            lambda t, state: F.array(
                marker(F.concat(F.lit(template.opening), template.label(t["role"]), F.lit(template.after_label))),
                F.struct(template.escape(t["text"]).alias("text"), template.loss(state).alias("loss")),
                marker(F.lit(template.closing)),
            ),
        )
    )
    last = F.element_at("path", -1)
    state = F.when(last.startswith(BROKEN), "error").otherwise(last)
    out = by_conv.select("conv_id", F.size("t").alias("n_turns"), state.alias("state"), segments.alias("segments"))
    return out.select("conv_id", "n_turns", F.col("state").isin(*template.accepts).alias("valid"), "state", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """`conv_id`, the turns `(role, text)` parsed from `formatted`, and the learned texts taken from `segments`, with what the machine
    made of it."""
    quoted = "\\Q" + template.closing.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.split("formatted", quoted)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = len(template.opening)

    def parse(piece: Column) -> Column:
        label = F.substring_index(F.substring(piece, cut + 1, 1 << 30), template.after_label, 1)
        body = piece.substr(F.length(label) + cut + len(template.after_label) + 1, F.length(piece))
        return F.struct(template.role(label).alias("role"), template.unescape(body).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"] == 1), lambda s: template.unescape(s["text"]))
    return formatted.select("conv_id", F.transform(pieces, parse).alias("turns"), learned.alias("learned"), "formatted", "state", "valid")


def digest(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    back = read_back(formatted, template)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    joined = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"),
        F.sha2(joined.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )


#: A conversation whose texts hold every control string of the template.
PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """`turns` and conversation -7, which says `PROBE_TEXT` as user and as assistant."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


ORACLE = r"""
with t as (
  select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, coalesce(role, '') r, coalesce("text", '') x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f as (
  select *, 4 + 2 + 8 + case r when 'system' then 6 when 'user' then 4 when 'assistant' then 9 else 1 + length(r) + length(r) - length(translate(r, '\#<:', '')) end
    + length(x) + length(x) - length(translate(x, '\#<:', '')) as n,
    coalesce(lag(r) over w, 'start') || '>' || r as move, row_number() over w as k
  from t window w as (partition by conv_id order by turn nulls first, r, x)
), g as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) as turns_sha256,
    cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) as loss_sha256,
    cast(sum(n) as bigint) as formatted_chars,
    case when bool_and(move in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) then arg_max(r, k) else 'error' end as state
  from f group by conv_id
)
select *, state = 'assistant' as valid from g
"""
