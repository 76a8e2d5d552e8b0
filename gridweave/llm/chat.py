"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is the set of its nested field paths; the hash of that set picks a declarative
mapping (where the turns are, what the roles are called), and the mapping turns any layout into
canonical turns (conversation, position, role, text). A template then writes the turns as one string
whose control strings cannot occur in a text: in texts they are broken by an escape sign, reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .decontam import let

# Control strings of common chat templates; none may be left whole in a text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


@dataclass(frozen=True)
class Template:
    """Marks of a turn: start + role + middle + text + end. All begin with a control string."""

    start: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>\n"
    learn: tuple[str, ...] = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """Layout `paths` -> turns: either `fields` (path -> role, in order), or a list at `turns` with a role and a text field."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = field(default=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant")))


# The layouts that are known.
MAPPINGS = (
    Mapping("turn", ("role", "text"), turns="", role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("prompt", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", ("input", "instruction", "output"), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("system_prompt", ("completion", "prompt", "system"), fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("nested", ("data.prompt", "data.response"), fields=(("data.prompt", "user"), ("data.response", "assistant"))),
)


def _tree(paths) -> dict:
    tree: dict = {}
    for p in paths:
        at = tree
        for x in p.split("."):
            at = at.setdefault(x, {})
    return tree


def skeleton(paths) -> str:
    """Nested field paths as one string, in the form of `record_skeleton`."""

    def write(t: dict) -> str:
        parts = []
        for k in sorted(t):
            inner = write(t[k]) if t[k] else "v"
            parts.append(f"{k[:-2]}: ARRAY<{inner}>" if k.endswith("[]") else f"{k}: {inner}")
        return "OBJECT<" + ", ".join(parts) + ">"

    return write(_tree(paths))


def record_skeleton(record: Column) -> Column:
    """The nested field paths of a variant, as text: its schema with every scalar type replaced by v."""
    s = F.regexp_replace(F.schema_of_variant(record), r"\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "v")
    return s


def _roles(mapping: Mapping, role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in mapping.roles:
        out = F.when(role == a, b).otherwise(out)
    return out


def _turn(m: Mapping):
    return lambda t: F.struct(_roles(m, t[m.role]).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """JSON records -> (id, layout, fingerprint, pos, role, text), one row a turn.

    `record_col` is JSON text or a struct. Records that do not parse or have an unknown layout give one row with a
    null layout, role and text, so that nothing is lost unseen. Null texts become empty, null roles
    empty, and roles are renamed as the mapping says. Empty lists of turns give no row. Columns other
    than the two named are ignored.
    """
    is_struct = isinstance(records.schema[record_col].dataType, T.StructType)
    v = F.to_variant_object(record_col) if is_struct else F.try_parse_json(F.col(record_col).cast("string"))
    r = records.select(F.col(id_col).alias("id"), v.alias("v"))
    r = r.withColumn("fingerprint", F.xxhash64(record_skeleton(F.col("v"))))
    known = [(m, F.xxhash64(F.lit(skeleton(m.paths)))) for m in mappings]
    turn = "array<struct<role string, text string>>"
    turns, layout = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))).cast(turn), F.lit(None).cast("string")
    for m, h in known:
        get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
        if m.turns:
            listed = F.try_variant_get("v", f"$.{m.turns}", f"array<struct<`{m.role}` string, `{m.text}` string>>")
            found = F.transform(listed, _turn(m))
        elif m.fields:
            found = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(get(p), F.lit("")).alias("text")) for p, role in m.fields))
        else:
            found = F.array(F.struct(_roles(m, get(m.role)).alias("role"), F.coalesce(get(m.text), F.lit("")).alias("text")))
        turns, layout = F.when(F.col("fingerprint") == h, found).otherwise(turns), F.when(F.col("fingerprint") == h, m.name).otherwise(layout)
    out = r.select("id", layout.alias("layout"), "fingerprint", F.posexplode(turns).alias("pos", "turn"))
    return out.select(F.col("id").alias(id_col), "layout", "fingerprint", F.col("pos").cast("long").alias("pos"), "turn.role", "turn.text")


def turn_rows(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows that are turns already -> (id, pos, role, text): each goes as a record of role and text through `canonical_turns`.

    Null texts and roles become empty; repeated rows are repeated turns; other columns are ignored; an empty table gives no
    rows. A record of more than 128 MiB is over what a variant holds and is an error.
    """
    key = F.struct(F.col(id_col).alias("id"), F.col(turn_col).alias("pos"))
    records = rows.select(key.alias("key"), F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("record"))
    t = canonical_turns(records, "key", "record", mappings)
    return t.select(F.col("key.id").alias(id_col), F.col("key.pos").alias("pos"), "role", "text")


def escape(text: Column) -> Column:
    """Breaks every control string by a backslash after its first sign, and doubles backslashes."""
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """(id, pos, role, text) -> one row a conversation: id, n_turns, formatted, loss_spans, loss_bytes.

    Turns stand in the order of pos, then role and text (nulls first). loss_spans are the [start, end)
    code points of `formatted` that are learned: the escaped texts of the roles in `template.learn`;
    loss_bytes the same in UTF-8 bytes. Null roles and texts count as empty; repeated rows are
    repeated turns; a null id is a conversation of its own. An empty table gives no rows. A
    conversation is one string, so its turns meet in one task: positions come from a window over the
    same shuffle, and nothing larger than the conversation is held.
    """
    t = turns.select(F.col(id_col).alias("id"), "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(template.start), escape(F.col("role")), F.lit(template.middle))
    t = t.select("id", "pos", F.col("role").isin(*template.learn).alias("learn"), "role", head.alias("head"), escape(F.col("text")).alias("body"))
    end = len(template.end)
    by = Window.partitionBy("id").orderBy("pos", "role", "body")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    t = t.select(
        "id", "learn", "head", "body", F.row_number().over(by).alias("n"),
        F.coalesce(F.sum(F.length("head") + F.length("body") + end).over(before), zero).alias("at"),
        F.coalesce(F.sum(F.octet_length("head") + F.octet_length("body") + end).over(before), zero).alias("byte"),
    )
    a, b = F.col("at") + F.length("head"), F.col("byte") + F.octet_length("head")
    span = F.when(F.col("learn"), F.struct(a.alias("start"), (a + F.length("body")).alias("end"), b.alias("byte_start"), (b + F.octet_length("body")).alias("byte_end")))
    t = t.select("id", F.struct("n", F.concat("head", "body", F.lit(template.end)).alias("piece"), span.alias("span")).alias("p"))
    g = t.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    spans = F.filter(F.col("p.span"), lambda s: s.isNotNull())
    return g.select(
        F.col("id").alias(id_col),
        F.size("p").cast("long").alias("n_turns"),
        F.array_join("p.piece", "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        F.transform(spans, lambda s: F.struct(s["byte_start"].alias("start"), s["byte_end"].alias("end"))).alias("loss_bytes"),
    )


def parse_chat(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    quote = lambda s: rf"\Q{s}\E"
    pieces = F.slice(F.split(formatted, quote(template.start)), F.lit(2), F.lit(2**31 - 2))

    def turn(p):
        i = F.instr(p, template.middle)
        return F.struct(
            unescape(F.substring(p, F.lit(1), i - 1)).alias("role"),
            unescape(F.substring(p, i + len(template.middle), F.length(p) - i - (len(template.middle) + len(template.end) - 1))).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss_bytes: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    return let(raw, lambda b: unescape(F.array_join(F.transform(loss_bytes, lambda s: F.substring(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")), "")))


def digests(chats: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """What a reader gets back from formatted conversations."""
    c = chats.select(id_col, F.length("formatted").cast("long").alias("formatted_chars"), parse_chat(F.col("formatted"), template).alias("t"), loss_text(F.col("formatted"), F.col("loss_bytes")).alias("loss"))
    return c.select(
        id_col,
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_sql(x: str) -> str:
    for c in ("\\", *CONTROLS):
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {_escaped_sql("text")} AS et, {_escaped_sql("role")} AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(et) + length(er) + {len(Template().start) + len(Template().middle) + len(Template().end)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
