r"""Chat formatting by schema fingerprints.  DataFrame functions only.

Layouts.  A ``Layout`` declares which nested field paths a record must have and how they become canonical turns.  A record's paths are
those of all its lists' elements together.  Its fingerprint under a layout is the hash of those of the layout's required paths that it has; the
first layout whose own fingerprint that is gives the mapping, so further fields don't matter and lists of messages come before single fields.  The
``fingerprint`` column is the hash of all declared paths that the record has.  ``turns_of_json`` does this per record of mixed JSON;
``turns_of_columns`` once, from a DataFrame's schema.

Messages.  Each message of a list takes the first of its layout's role and text fields that it has, so a list may mix them.  A text may be a list
of parts: their texts are joined, and parts without one (images, say) add nothing.

Template.  ``<s>role[INST]text[/INST]</s>`` per turn.  Inside roles and texts a backslash goes before each backslash and after the
first sign of each control string, so none is left there; dropping each such backslash gives the text back.  The loss mask is an array of
code point spans, one for each assistant text.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), role, text; repeated rows are turns of
their own; rows of a null conversation are one conversation; an empty list of messages has no turns; a record that fits no layout keeps its row
with null turns and the layout ``unknown``; an empty table gives an empty one; further columns are ignored.  A conversation is one output row
and must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import running

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, paths) for fields, whose non-empty texts are joined by an empty line; or ``each``: (array path, role fields,
    text fields) for lists of messages, roles renamed by ``roles``, after the ``lead`` (role, path) where that isn't empty."""

    name: str
    required: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    lead: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=lambda: {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}, hash=False)

    def paths(self) -> set[str]:
        """All that the mapping reads."""
        out = {*self.required, *(p for _, ps in self.turns for p in ps), *(p for _, p in self.lead)}
        if self.each:
            path, roles, texts = self.each
            out |= {f"{path}[].{x}" for x in (*roles, *texts)} | {f"{path}[].{x}[].text" for x in texts}
        return out


_ROLES, _TEXTS, _SYSTEM = ("role", "from"), ("content", "text", "value"), (("system", "system"),)
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", _ROLES, _TEXTS), lead=_SYSTEM),
    Layout("turn rows", ("messages[].role", "messages[].text"), each=("messages", _ROLES, ("text", "content", "value")), lead=_SYSTEM),
    Layout("from and value", ("conversations[].from", "conversations[].value"), each=("conversations", ("from", "role"), ("value", "content", "text")), lead=_SYSTEM),
    Layout("other conversations", ("conversations[]",), each=("conversations", ("from", "role"), ("value", "content", "text")), lead=_SYSTEM),
    Layout("other messages", ("messages[]",), each=("messages", _ROLES, _TEXTS), lead=_SYSTEM),
    Layout("instruction", ("instruction", "output"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction and response", ("instruction", "response"), (("system", ("system",)), ("user", ("instruction", "context", "input")), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("question", "answer"), (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def vocabulary(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths()})


def paths_of(schema: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; [] stands for an array's elements."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)} | {prefix}
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, prefix + "[]") | {prefix, prefix + "[]"}
    return {prefix}


def _joined(texts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), lambda t: t != ""), "\n\n")


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]), role), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, scalar, messages) -> Column:
    """A layout's canonical turns, ``scalar`` and ``messages`` giving the values at its paths."""
    if layout.each:
        turns = F.transform(messages(*layout.each), lambda m: _turn(_renamed(m["role"], layout.roles), m["text"]))
        lead = [F.when(F.coalesce(scalar(p), F.lit("")) != "", F.array(_turn(F.lit(r), scalar(p)))).otherwise(F.expr(f"cast(array() as {_TURNS})")) for r, p in layout.lead]
        return F.concat(*lead, F.coalesce(turns, F.expr(f"cast(array() as {_TURNS})"))).cast(_TURNS)
    made = F.array(*[_turn(F.lit(role), _joined([scalar(p) for p in paths])) for role, paths in layout.turns])
    return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != "")).cast(_TURNS)


def turns_of_json(df: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with the columns layout, fingerprint and turns for its JSON records, which may differ from row to row."""
    words = vocabulary(layouts)
    v, each = F.col("_v"), "array<variant>"
    at = lambda x, path, kind: F.try_variant_get(x, f"$.{path}", kind)
    lists = sorted({p.split("[]")[0] for p in words if "[]" in p})

    def has(path: str) -> Column:
        head, *rest = path.split("[]")
        if not rest:
            return F.coalesce(at(v, head, "string"), F.lit("")) != ""
        below = [p.strip(".") for p in rest if p]
        if not below:
            return F.col(f"_list_{head}").isNotNull()
        if len(below) == 1:
            return F.exists(f"_list_{head}", lambda m: at(m, below[0], "string").isNotNull())
        return F.exists(f"_list_{head}", lambda m: F.exists(at(m, below[0], each), lambda part: at(part, below[1], "string").isNotNull()))

    def value(message: Column, names: tuple[str, ...]) -> Column:
        """The first of the fields that a message has; a list's parts are joined."""
        found = []
        for x in names:
            parts = F.filter(F.transform(at(message, x, each), lambda part: F.coalesce(at(part, "text", "string"), F.try_variant_get(part, "$", "string").substr(F.lit(1), F.when(F.schema_of_variant(part) == "STRING", F.lit(1 << 30))))), lambda t: t.isNotNull())
            found += [F.array_join(parts, ""), at(message, x, "string")]
        return F.coalesce(*found)

    messages = lambda path, roles, texts: F.transform(f"_list_{path}", lambda m: F.struct(F.coalesce(*[at(m, r, "string") for r in roles]).alias("role"), value(m, texts).alias("text")))
    known = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), F.try_parse_json(df[record_col]).alias("_v"))
    known = known.select("*", *[at(v, p, each).alias(f"_list_{p}") for p in lists])
    held = known.withColumn("_p", F.filter(F.array(*[F.when(has(p), F.lit(p)) for p in words]), lambda p: p.isNotNull()))
    print_of = lambda paths: F.xxhash64(F.array_join(paths, "|"))
    layout, turns = F.lit("unknown"), F.lit(None).cast(_TURNS)
    for x in reversed(layouts):
        need = F.array(*[F.lit(p) for p in sorted(x.required)])
        layout = F.when(print_of(F.array_intersect(need, "_p")) == print_of(need), F.lit(x.name)).otherwise(layout)
        turns = F.when(F.col("_l") == x.name, _mapped(x, lambda p: at(v, p, "string"), messages)).otherwise(turns)
    out = held.withColumn("_f", print_of(F.col("_p"))).withColumn("_l", layout).withColumn("_t", turns)
    kept = [c for c in df.columns if c not in ("layout", "fingerprint", "turns")]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_l").alias("layout"), F.col("_f").alias("fingerprint"), F.col("_t").alias("turns"))


def turns_of_columns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str, Column]:
    """The layout's name and the canonical turns of a DataFrame whose columns are a record's fields."""
    has = paths_of(df.schema)
    print_of = lambda paths: hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()
    chosen = next((x for x in layouts if print_of(has & set(x.required)) == print_of(x.required)), None)
    if chosen is None:
        return "unknown", F.lit(None).cast(_TURNS)

    def messages(path: str, roles: tuple[str, ...], texts: tuple[str, ...]) -> Column:
        own = lambda names: [x for x in names if has & {f"{path}[].{x}", f"{path}[].{x}[]"}]

        def text(m: Column, x: str) -> Column:
            if f"{path}[].{x}[].text" in has:
                return F.array_join(F.transform(m[x], lambda part: part["text"].cast("string")), "")
            return F.array_join(m[x], "") if f"{path}[].{x}[]" in has else m[x].cast("string")

        return F.transform(df[path], lambda m: F.struct(F.coalesce(F.lit(None).cast("string"), *[m[r].cast("string") for r in own(roles)]).alias("role"), F.coalesce(F.lit(None).cast("string"), *[text(m, x) for x in own(texts)]).alias("text")))

    scalar = lambda p: df[p].cast("string") if p in has else F.lit(None).cast("string")
    return chosen.name, _mapped(chosen, scalar, messages)


# --- the template

OPEN, ROLE_END, TEXT_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, CLOSE, ROLE_END, TEXT_END)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Struct of text and loss, the spans (start, end) of the texts that a model learns from."""
    parts = F.transform(turns, lambda t: F.struct(t["role"].isin(*loss_roles).alias("loss"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("head"), escape(t["text"]).alias("body")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(TEXT_END + CLOSE))), "")
    before = running(F.transform(parts, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(TEXT_END + CLOSE)).cast("bigint")), "sum")
    spans = F.zip_with(parts, before, lambda p, at: F.when(p["loss"], F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end"))))
    return F.struct(text.alias("text"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def parsed(text: Column) -> Column:
    """The turns that ``formatted`` wrote."""
    pieces = F.split(text, re.escape(CLOSE), -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(whole, lambda s: F.struct(unescape(F.substr(F.substring_index(s, ROLE_END, 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substring_index(F.substring_index(s, ROLE_END, -1), TEXT_END, 1)).alias("text")))


def under_mask(text: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversations_of_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, messages) from one row per turn."""
    rows = df.select(df[conv_col].alias("conv_id"), F.struct(df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text")).alias("m"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, layout, text, loss) from one row per turn."""
    grouped = conversations_of_rows(df, conv_col, turn_col, role_col, text_col)
    layout, turns = turns_of_columns(grouped)
    return grouped.select("conv_id", F.lit(layout).alias("layout"), formatted(turns).alias("f")).select("conv_id", "layout", F.col("f.text").alias("text"), F.col("f.loss").alias("loss"))
