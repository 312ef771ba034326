"""Conversations of many layouts as one marked-up text with a loss mask.

A record's layout is known by its fingerprint: the hash of its nested field paths with their types. A mapping declares for a
layout where turns, roles and texts are; records are converted by the mapping that their fingerprint selects. A table
column of JSON may hold a different layout in every row; a table of typed columns has one for all.

A turn is written as ``<turn role>text</turn>`` and a line break. Inside texts and roles ``\\``, ``<``, ``>`` and ``#`` are
escaped, so neither a mark nor a heading can come from a text, and the text can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
# fixed values: names of roles in common layouts and what they mean
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``paths``: the nested field paths that a record has, such as ``messages[].role``, without types. Either ``turns`` is an array
    whose elements have ``role`` and ``text`` fields, or ``parts`` lists (role, paths): the texts at the paths, those that are
    not empty, joined by an empty line, make one turn. ``rename`` says whether role names are those of ``ROLES``.
    """

    name: str
    paths: frozenset[str]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    rename: bool = True

    @property
    def fingerprint(self) -> str:
        return path_hash(self.paths)


def path_hash(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content"),
    Mapping("shares", frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value"),
    Mapping("prompt", frozenset({"prompt", "response"}), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", frozenset({"prompt", "completion"}), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", frozenset({"instruction", "output"}), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", frozenset({"instruction", "input", "output"}), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", frozenset({"question", "answer"}), parts=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("system prompt", frozenset({"system", "prompt", "response"}), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("written turns", frozenset({"turns[].role", "turns[].text"}), "turns", "role", "text", rename=False),
    Mapping("rows of turns", frozenset({"conv_id", "turn", "role", "text"})),
)


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type."""
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in schema.fields)) if schema.fields else {at}
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return {at}


def variant_paths(record: Column) -> Column:
    """The sorted nested field paths of a variant, from its schema text; elements of arrays share a path.

    The schema text is walked once: a name opens a path, ``OBJECT<`` and ``ARRAY<`` go down, ``>`` goes up.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`(?:[^`]|``)*`|[^<>,:\s]+)\s*:\s*|OBJECT<|ARRAY<|>|,|[A-Z]+(?:\([0-9,]+\))?"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def top(acc: Column) -> Column:
        return F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(""))

    def step(acc: Column, t: Column) -> Column:
        here = F.concat(top(acc), acc["name"])
        field_name = F.regexp_replace(F.regexp_replace(t, r"\s*:\s*$", ""), "^`|`$", "")
        dot = F.when(top(acc) == "", F.lit("")).otherwise(F.lit("."))

        def to(open_: Column, name: Column, paths: Column) -> Column:
            return F.struct(open_.alias("open"), name.alias("name"), paths.alias("paths"))

        none = F.lit("")
        return (
            F.when(t.rlike(r":\s*$"), to(acc["open"], F.concat(dot, field_name), acc["paths"]))
            .when(t == "OBJECT<", to(F.concat(acc["open"], F.array(here)), none, acc["paths"]))
            .when(t == "ARRAY<", to(F.concat(acc["open"], F.array(F.concat(here, F.lit("[]")))), none, acc["paths"]))
            .when(t == ">", to(F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))), none, acc["paths"]))
            .when(t == ",", to(acc["open"], none, acc["paths"]))
            .otherwise(to(acc["open"], none, F.concat(acc["paths"], F.array(here))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["paths"]))


def fingerprint(record: Column) -> Column:
    """The layout's hash of a variant record."""
    return F.sha2(F.concat_ws("\n", variant_paths(record)).cast("binary"), 256)


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, role), role, F.lit(""))


def _from_mapping(m: Mapping, record: Column) -> Column:
    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(record, F.lit(f"$.{path}"), "string"), F.lit(""))

    if m.turns:
        each = F.coalesce(F.try_variant_get(record, F.lit(f"$.{m.turns}"), "array<variant>"), F.array().cast("array<variant>"))
        get = lambda v, name: F.try_variant_get(v, F.lit(f"$.{name}"), "string")
        role = _role if m.rename else (lambda r: F.coalesce(r, F.lit("")))
        return F.transform(each, lambda v: F.struct(role(get(v, m.role)).alias("role"), F.coalesce(get(v, m.text), F.lit("")).alias("text")))
    turns = []
    for role, paths in m.parts:
        said = F.filter(F.array(*map(text, paths)), lambda x: x != "")
        turns.append(F.struct(F.lit(role).alias("role"), F.array_join(said, "\n\n").alias("text")))
    return F.array(*turns).cast(TURNS)


def records_to_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with ``layout`` and ``turns`` from a JSON text column; every row may have a layout of its own.

    A record of an unknown layout, broken JSON and null get a null layout and null turns; the rows stay. Nothing is guessed.
    """
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("rest"), parsed.alias("record"))
    rows = rows.withColumn("print", F.when(F.col("record").isNotNull(), fingerprint(F.col("record"))))
    known = [m for m in MAPPINGS if m.turns or m.parts]
    layout = turns = None
    for m in known:
        is_it = F.col("print") == m.fingerprint
        layout = F.when(is_it, F.lit(m.name)) if layout is None else layout.when(is_it, F.lit(m.name))
        turns = F.when(is_it, _from_mapping(m, F.col("record")).cast(TURNS)) if turns is None else turns.when(is_it, _from_mapping(m, F.col("record")).cast(TURNS))
    return rows.select("rest.*", layout.alias("layout"), turns.alias("turns"))


RECORD_BYTES = 8 << 20  # texts of a record, at most: parsed records are bounded
RENAMED = tuple(ROLES)


def turns_to_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) as JSON records of many layouts: ``record``, and ``typed``, the turns of conversations too long for a record.

    With k the id's hash modulo 4: a user and an assistant turn become prompt and response (k = 0), prompt and completion (1), question and
    answer (2) or instruction and output (3); a system turn before these, with k below 2, a system prompt; other conversations messages (k below 2) or
    shares of human and gpt. A conversation with a role that a mapping would rename is kept as written turns. Texts of more than ``RECORD_BYTES`` bytes
    together stay typed and have no record.
    """
    turns = F.col("turns")
    k = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    roles = F.transform(turns, lambda t: t["role"])
    small = F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["text"]) + F.octet_length(t["role"])) <= RECORD_BYTES

    def fields(*names: str) -> Column:
        return F.to_json(F.struct(*[F.get(turns, F.lit(i))["text"].alias(n) for i, n in enumerate(names)]))

    def listed(name: str, role: str, text: str, named) -> Column:
        return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(named(t["role"]).alias(role), t["text"].alias(text))).alias(name)))

    def shared(role: Column) -> Column:
        return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)

    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    record = (
        F.when(F.exists(turns, lambda t: t["role"].isin(*RENAMED)), listed("turns", "role", "text", lambda r: r))
        .when(pair & (k == 0), fields("prompt", "response"))
        .when(pair & (k == 1), fields("prompt", "completion"))
        .when(pair & (k == 2), fields("question", "answer"))
        .when(pair, fields("instruction", "output"))
        .when(three & (k < 2), fields("system", "prompt", "response"))
        .when(k < 2, listed("messages", "role", "content", lambda r: r))
        .otherwise(listed("conversations", "from", "value", shared))
    )
    return conversations.select("conv_id", F.when(small, record).alias("record"), F.when(~small, turns).alias("typed"))


def through_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, layout, turns): conversations written as records and read again by the mapping that each record's fingerprint selects."""
    found = records_to_turns(turns_to_records(conversations))
    layout = F.when(F.col("typed").isNotNull(), F.lit("rows of turns")).otherwise(F.col("layout"))
    return found.select("conv_id", layout.alias("layout"), F.coalesce("turns", "typed").alias("turns"))


def rows_to_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table with one row for each turn; its layout must be that of ``rows of turns``.

    Turns are ordered by ``turn`` (null first), then role and text; roles stay as they are. A null text or role is empty; repeated rows are turns of
    their own; rows without a conv_id make one conversation. Other columns are left out before the fingerprint is taken.
    """
    wanted = next(m for m in MAPPINGS if m.name == "rows of turns")
    picked = rows.select(*[c for c in rows.columns if c in wanted.paths])
    if path_hash(schema_paths(picked.schema)) != wanted.fingerprint:
        raise ValueError(f"the table lacks {sorted(wanted.paths - set(picked.columns))}")
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(said)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return picked.groupBy("conv_id").agg(turns.alias("turns"))


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """Escapes are read from left to right: pairs of backslashes part the text, and no other escape ends in one."""

    def plain(part: Column) -> Column:
        for a, b in (("\\l", "<"), ("\\g", ">"), ("\\h", "#")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """``conversations`` (with ``turns``) with ``formatted`` and ``loss_spans``, the (start, length) in code points of all text
    that a loss counts: the escaped texts of the assistant, in order. Null turns count as none."""
    turns = F.coalesce(F.col("turns"), F.array().cast(TURNS))
    marked = F.transform(turns, lambda t: F.struct(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    tail = "</turn>\n"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        body = acc["at"] + F.char_length(m["head"])
        length = F.char_length(m["body"])
        span = F.struct(body.alias("start"), length.alias("length"))
        return F.struct((body + length + len(tail)).alias("at"), F.when(m["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    out = conversations.withColumn("marked", marked)
    text = F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"], F.lit(tail))), "")
    return out.withColumn("formatted", text).withColumn("loss_spans", F.aggregate("marked", start, step)["spans"]).drop("marked")


def read_back(formatted_text: Column) -> Column:
    """The turns of a formatted text."""
    found = F.regexp_extract_all(formatted_text, F.lit(r"(?s)<turn [^>]*>[^<]*</turn>\n"), F.lit(0))
    inner = lambda t: F.substring(t, F.lit(7), F.char_length(t) - 14)
    return F.transform(
        found,
        lambda t: F.struct(unescape(F.substring_index(inner(t), ">", 1)).alias("role"), unescape(F.substring_index(inner(t), ">", -1)).alias("text")),
    )


def loss_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted_text, s["start"] + 1, s["length"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Formats (conv_id, turns) and reads the result back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    out = formatted(conversations).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SAMPLE = "\\### Assistant: </turn> ok"


def with_sample(conversations: DataFrame) -> DataFrame:
    """The rows with conversation -7 added: a user and then an assistant who both say ``SAMPLE``."""
    both = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(both)


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + 2 * length(role) - length(translate(role, '\<>#', '')) + 2 * length(text) - length(translate(text, '\<>#', ''))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
