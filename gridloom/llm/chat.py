"""Chat formatting of typed content parts, DataFrame functions only.

A turn is a list of parts: text, image, audio or document.  A visitor flattens
it: texts that follow each other are one text, which is escaped as a whole; any
other part becomes an ordered placeholder, and its reference and the tokens that
it will expand to are recorded.  Turns are then marked by the template::

    user       [INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant  <s>text</s>
    other      [ROLE] role[:] text [/ROLE]

Escaping doubles every backslash and puts one behind the first character of
each control string, so that no text can hold one, however it is cut into parts;
dropping each backslash and keeping what follows undoes it.  The loss mask lists
(start, length) of the assistant's turns in characters of the formatted string.
``parsed`` reads all of this back from the formatted string and the mask alone:
what shows as a placeholder is a part, any other character belongs to a text.

A conversation is one string, so its turns meet in one row: that is the unit of
the result, and no other rows come together.  Offsets are running sums.

Defined cases.  Null texts and roles are empty, and empty texts are no parts when
read back.  Turns are ordered by number (null first), then role, then text;
repeated rows are turns of their own.  Rows of null conversation id form one
conversation.  A part of unknown kind fails the job.  Very long texts are used
whole.  An empty table gives no conversations.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the template's control strings
CONTROLS = ["[INST]", "[/INST]", "[SYS]", "[/SYS]", "<s>", "</s>", "[ROLE]", "[:]", "[/ROLE]", "[IMAGE]", "[AUDIO]", "[DOCUMENT]"]
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Tokens that one unit of a part expands to: a tile of an image, a frame of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 1, "document": 512}

PART = "struct<kind:string,text:string,ref:string,units:bigint>"

_TAIL = "|".join(c[1:].replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)
_TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|<s>.*?</s>|\[ROLE\] .*? \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_TAIL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _flat(parts: Column) -> Column:
    """The visitor: one string, attachments in place."""

    def visit(seen: Column, p: Column) -> Column:
        mark = F.when(p["kind"] == "text", F.lit(""))
        for kind, shown in PLACEHOLDERS.items():
            mark = mark.when(p["kind"] == kind, F.lit(shown))
        mark = mark.otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(p["kind"], F.lit("null")))))
        open_ = F.concat(seen["open"], F.coalesce(p["text"], F.lit("")))
        return F.when(mark == "", F.struct(seen["done"].alias("done"), open_.alias("open"))).otherwise(F.struct(F.concat(seen["done"], escape(seen["open"]), mark).alias("done"), F.lit("").alias("open")))

    # a text is open as long as texts follow it
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(_given(parts), start, visit, lambda seen: F.concat(seen["done"], escape(seen["open"])))


def _given(parts: Column) -> Column:
    return F.coalesce(parts, F.array().cast(f"array<{PART}>"))


def _plain(parts: Column) -> Column:
    """The texts as they are."""
    return F.array_join(F.transform(F.filter(_given(parts), lambda p: p["kind"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def _attached(parts: Column) -> Column:
    def record(p: Column) -> Column:
        each = F.lit(None).cast("long")
        for kind, n in TOKENS_PER_UNIT.items():
            each = F.when(p["kind"] == kind, F.lit(n).cast("long")).otherwise(each)
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (each * F.coalesce(p["units"], F.lit(1))).alias("tokens"))

    return F.transform(F.filter(parts, lambda p: p["kind"] != "text"), record)


def _framed(role: Column, text: Column) -> tuple[Column, Column]:
    """The turn as formatted, and where its text begins in that."""
    body = F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]"))).when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
    return body.otherwise(F.concat(F.lit("[ROLE] "), escape(role), F.lit("[:] "), text, F.lit(" [/ROLE]"))), F.length(F.lit("<s>"))


def formatted(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """id, formatted, mask, attachments: one row per conversation."""
    content = turns.select(F.col(id).alias("_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), _flat(F.col(parts)).alias("_text"), _plain(F.col(parts)).alias("_plain"), _attached(F.col(parts)).alias("_attached"))
    body, inset = _framed(F.col("_role"), F.col("_text"))
    framed = content.withColumn("_body", body).withColumn("_chars", F.length("_body").cast("long"))
    order = Window.partitionBy("_id").orderBy("_turn", "_role", "_plain", "_text", "_attached")
    placed = framed.withColumn("_at", F.row_number().over(order)).withColumn("_start", F.sum("_chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_chars"))
    span = F.when(F.col("_role") == "assistant", F.struct((F.col("_start") + inset).alias("start"), F.length("_text").cast("long").alias("length")))
    whole = placed.select("_id", F.struct("_at", "_body", span.alias("_span"), "_attached").alias("_t")).groupBy("_id").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    return whole.select(
        F.col("_id").alias(id),
        F.array_join(F.transform("_ts", lambda t: t["_body"]), "").alias("formatted"),
        F.filter(F.transform("_ts", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("mask"),
        F.flatten(F.transform("_ts", lambda t: F.coalesce(t["_attached"], F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")))).alias("attachments"),
    )


# no escaped text holds a placeholder, so each one that is seen is a part
_MARK = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in PLACEHOLDERS.values())
_PIECE = rf"(?s){_MARK}|.+?(?={_MARK}|\z)"


def _read(shown: Column) -> Column:
    """The parts of a formatted turn: kind and text, which is null for attachments."""

    def part(p: Column) -> Column:
        kind = F.lit("text")
        for name, mark in PLACEHOLDERS.items():
            kind = F.when(p == mark, F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("kind"), F.when(kind == "text", unescape(p)).alias("text"))

    return F.transform(F.regexp_extract_all(shown, F.lit(_PIECE), F.lit(0)), part)


def _texts(shown: Column) -> Column:
    """The text of a formatted turn, without its placeholders."""
    return unescape(F.regexp_replace(shown, _MARK, ""))


def parsed(chats: DataFrame) -> DataFrame:
    """Adds turns (role, text, parts) and loss_text, both read from formatted and mask and unescaped."""

    def back(t: Column) -> Column:
        inside = lambda open_, close: F.substring(t, F.lit(len(open_) + 1), F.length(t) - len(open_) - len(close))
        other = inside("[ROLE] ", " [/ROLE]")
        name = F.substring_index(other, "[:] ", 1)
        of = lambda r, x: F.struct(unescape(r).alias("role"), _texts(x).alias("text"), _read(x).alias("parts"))
        return (
            F.when(t.startswith("[INST] "), of(F.lit("user"), inside("[INST] ", " [/INST]")))
            .when(t.startswith("[SYS] "), of(F.lit("system"), inside("[SYS] ", " [/SYS]")))
            .when(t.startswith("<s>"), of(F.lit("assistant"), inside("<s>", "</s>")))
            .otherwise(of(name, F.substring(other, F.length(name) + 5, F.length(other))))
        )

    cut = F.transform("mask", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return chats.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), back)).withColumn("loss_text", F.array_join(F.transform(cut, _texts), ""))


def text_parts(rows: DataFrame, text: str = "text", name: str = "parts") -> DataFrame:
    """Rows of plain text as turns of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return rows.withColumn(name, F.array(part))
