"""Chat formatting by schema fingerprint, with DataFrame functions only.

A record is a variant. Its fingerprint is the hash of its nested field paths (field names and nesting, no types). A table of
declarative layouts, looked up by fingerprint, says where a record keeps its turns; records become canonical turns (role,
text), turns become one marked-up string for each conversation, with the spans of the text under the loss mask.

Template: `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and texts a backslash is doubled and a backslash is put after
the first character of every control string (of this template and of the common public ones), so no control string of the
template ever occurs in content, and dropping one backslash of each escape restores it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubila.llm.arrays import let, pieces, sums_before

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: A control string starts with the character before the look-ahead: this template's, and those of public chat templates.
CONTROL = r"<(?=\||/?s>|</?SYS>>|/?(?:start|end)_of_turn>)|\[(?=/?INST\])"
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where records of one shape keep their turns.

    shape: nested field paths as `paths()` writes them. each: the path of an array of turns, with `role` and `text` inside one;
    or turns: (role, paths joined by a blank line) for records with a field for each turn. A role that starts with `$` is a path.
    """

    name: str
    shape: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    aliases: bool = False


LAYOUTS = (
    Layout("turn", "OBJECT<role, text>", (("$.role", ("$.text",)),)),
    Layout("message", "OBJECT<content, role>", (("$.role", ("$.content",)),)),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", each="$.messages", role="$.role", text="$.content"),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", each="$.conversations", role="$.from", text="$.value", aliases=True),
    Layout("prompt_response", "OBJECT<prompt, response>", (("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("prompt_completion", "OBJECT<completion, prompt>", (("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("question_answer", "OBJECT<answer, question>", (("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Layout("instruction_output", "OBJECT<instruction, output>", (("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction_input_output", "OBJECT<input, instruction, output>", (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("system_instruction", "OBJECT<input, instruction, output, system>", (("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
)


def paths(record: Column) -> Column:
    """Nested field paths of a variant: its schema without the types of leaves; names come sorted."""
    leaf = r"(?<=[:<] |[:<])(?!OBJECT\b|ARRAY\b)[A-Z]+(?:\(\d+,\s*\d+\))?(?=[,>]|$)"
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), leaf, ""), r":\s*(?=[,>])", "")


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def _get(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _role(value: Column, aliases: bool) -> Column:
    if not aliases:
        return F.coalesce(value, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(value)), value, F.lit(""))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.each:
        inside = F.try_variant_get(record, layout.each, "array<variant>")
        return F.transform(inside, lambda t: F.struct(_role(_get(t, layout.role), layout.aliases).alias("role"), F.coalesce(_get(t, layout.text), F.lit("")).alias("text")))
    out = []
    for role, sources in layout.turns:
        who = _role(_get(record, role), layout.aliases) if role.startswith("$") else F.lit(role)
        if len(sources) == 1:
            text = F.coalesce(_get(record, sources[0]), F.lit(""))
        else:
            text = F.concat_ws("\n\n", *[F.nullif(_get(record, s), F.lit("")) for s in sources])
        out.append(F.struct(who.alias("role"), text.alias("text")))
    return F.array(*out)


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds shape, layout (null for an unknown shape) and turns (array of role and text; empty for an unknown shape).

    Null fields count as present and read as empty text; a null record has no shape. No row is dropped.
    """
    shaped = records.withColumn("shape", paths(F.col(record))).withColumn("__print", fingerprint(F.col("shape")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed(layouts):
        mine = F.col("__print") == fingerprint(F.lit(x.shape))
        name = F.when(mine, F.lit(x.name)).otherwise(name)
        turns = F.when(mine, _turns(F.col(record), x)).otherwise(turns)
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return shaped.withColumn("layout", name).withColumn("turns", F.coalesce(turns, empty)).drop("__print")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, place, role, text): conv_id, formatted, loss_spans.

    Turns are ordered by turn, place, role, text (nulls first), so ties and repeated rows have one result. Null roles and texts
    are empty. loss_spans holds start and length, in code points of `formatted`, of the escaped text of learned-from roles. Each
    turn is escaped and measured before the grouping; a conversation's string itself is one value, so one task holds it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    rows = turns.select("conv_id", F.struct("turn", "place", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    sizes = F.transform("ts", lambda t: F.char_length(t["head"]).cast("long") + F.char_length(t["body"]) + len(END))
    span = lambda t, at: F.struct((at + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length"), t["role"].isin(*learn_from).alias("learnt"))
    learnt = F.filter(F.zip_with("ts", sums_before(sizes), span), lambda s: s["learnt"])
    return grouped.select("conv_id", formatted.alias("formatted"), F.transform(learnt, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def parse_conversation(formatted: Column) -> Column:
    """The turns of a formatted string, read back: array of role and text."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    fields = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(p, r"<\|turn\|>|<\|text\|>", -1))
    return F.transform(fields, lambda f: F.struct(unescape(f[1]).alias("role"), unescape(f[2]).alias("text")))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    ends = F.transform(loss_spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end")))
    return F.array_join(F.transform(let(formatted, lambda text: pieces(text, ends)), unescape), "")
