"""Chat formatting with typed content parts, in SQL functions only.

A turn is a list of parts. A visitor goes through them in order: text is escaped and taken
over, every other part becomes a placeholder numbered through the conversation, and its
reference and the tokens that it will expand to are recorded beside the formatted text.

The template is ``<turn>role``, a line end, the flattened parts, ``</turn>`` and a line end. All
its control strings start with ``<``, which texts and roles lose by a reversible escape
(``&`` and ``<`` become entities), so no text can end a turn, open one or fake a placeholder.

Plain texts are read into parts first: an image of Markdown, ``![words](reference)``, is an image, or a sound or
document by the ending of its reference. Reading a conversation back puts the same text where the placeholder is.

Defined results: null texts and roles are empty; a null turn number sorts first; rows of one
conversation with the same turn are ordered by role and text; repeated rows are repeated turns; a
null conversation id is one conversation; an empty table gives no conversations; other columns are left
alone. A conversation becomes one row and so is held by one task. Places and numbers are running sums, so
that the work grows in proportion with turns and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import before_each, piece, quoted, text_blocks

PARTS = "array<struct<kind:string, text:string, ref:string, units:double>>"
OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that one unit of a part expands to: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
LOSS_ROLE = "assistant"
#: Endings of references that are no images.
ENDINGS = {"audio": "mp3 wav ogg flac m4a", "document": "pdf doc docx odt txt"}
MARKUP = r"!\[[^\]\[\n]*\]\([^()\s]*\)"
PLACEHOLDER = r"<[^<>:]*:([0-9]+)/>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def kind_of(reference: Column) -> Column:
    kind = F.lit("image")
    for name, endings in ENDINGS.items():
        kind = F.when(F.lower(reference).rlike(rf"\.({endings.replace(' ', '|')})([?#].*)?$"), F.lit(name)).otherwise(kind)
    return kind


def markup_parts(text: Column) -> Column:
    """A plain text as its parts: what is between attachments is text, every attachment keeps its words in ``text``."""
    found, gaps = F.regexp_extract_all(text, F.lit(MARKUP), F.lit(0)), F.split(text, MARKUP, -1)
    missing = F.lit(None).cast("string"), F.lit(None).cast("double")
    plain = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), missing[0].alias("ref"), missing[1].alias("units"))

    def attached(m: Column) -> Column:
        words = F.regexp_extract(m, r"^!\[([^\]]*)\]", 1)
        ref = F.substring(m, F.length(words) + 5, F.length(m) - F.length(words) - 5)
        return F.struct(kind_of(ref).alias("kind"), words.alias("text"), ref.alias("ref"), missing[1].alias("units"))

    mixed = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(plain(g))).otherwise(F.array(plain(g), attached(m)))))
    return F.when(F.contains(text, F.lit("![")), F.filter(mixed, lambda p: (p["kind"] != "text") | (p["text"] != ""))).otherwise(text_parts(text))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(n)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("long")


def format_turns(df: DataFrame, conv: Column, turn: Column, role: Column, parts: Column) -> DataFrame:
    """One row per conversation: ``conv, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are the places of the assistant's turns in ``formatted``, in code points, end
    exclusive. ``attachments`` lists number, kind, words, reference and tokens of each other part.
    """
    nothing = F.expr(f"cast(array() as {PARTS})")
    rows = df.select(conv.alias("conv"), F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), parts.cast(PARTS).alias("parts")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    add = lambda a, n: a + n
    told = lambda t, own: F.struct(t["role"].alias("role"), own.alias("parts"), F.transform(own, lambda p: F.when(_is_text(p), 0).otherwise(1)).alias("is_file"))
    grouped = grouped.select("conv", F.transform("turns", lambda t: told(t, F.coalesce(t["parts"], nothing))).alias("turns"))
    grouped = grouped.withColumns({
        "files": F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: ~_is_text(p)),
        "counts": F.transform("turns", lambda t: F.aggregate(t["is_file"], F.lit(0), add)),
    })
    grouped = grouped.withColumn("firsts", before_each(F.col("counts"), F.lit(0), add))

    def visit(p: Column, number: Column) -> Column:
        mark = F.concat(F.lit("<"), escape_role(p["kind"]), F.lit(":"), number.cast("string"), F.lit("/>"))
        return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    def made_of(t: Column, first: Column) -> Column:
        numbers = F.when(F.size(t["parts"]) == 1, F.array(first)).otherwise(before_each(t["is_file"], first, add))
        head = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
        return F.struct(t["role"].alias("role"), head.alias("head"), F.array_join(F.zip_with(t["parts"], numbers, visit), "").alias("body"))

    grouped = grouped.select("conv", "files", F.zip_with("turns", "firsts", made_of).alias("made"))
    grouped = grouped.withColumn("lengths", F.transform("made", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)))
    grouped = grouped.withColumn("starts", before_each(F.col("lengths"), F.lit(0), add))
    learnt = F.filter(F.arrays_zip("made", "starts"), lambda x: x["made"]["role"] == LOSS_ROLE)
    place = lambda x: x["starts"] + F.length(x["made"]["head"])
    return grouped.select(
        "conv",
        F.array_join(F.transform("made", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(learnt, lambda x: F.struct(place(x).alias("start"), (place(x) + F.length(x["made"]["body"])).alias("end"))).alias("loss_spans"),
        F.transform("files", lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), F.coalesce(p["text"], F.lit("")).alias("words"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"),
        F.aggregate("files", F.lit(0).cast("long"), lambda n, p: n + _tokens(p)).alias("expanded_tokens"),
    )


def restored(body: Column, attachments: Column) -> Column:
    """A formatted text as it was: escapes undone, placeholders as the markup that they stand for."""
    numbers, gaps = F.regexp_extract_all(body, F.lit(PLACEHOLDER), F.lit(1)), F.split(body, PLACEHOLDER, -1)

    def markup(k: Column) -> Column:
        file = F.get(attachments, k.cast("int"))
        return F.concat(F.lit("!["), file["words"], F.lit("]("), F.coalesce(file["ref"], F.lit("")), F.lit(")"))

    mixed = F.array_join(F.zip_with(gaps, numbers, lambda g, k: F.concat(unescape(g), F.when(k.isNull(), F.lit("")).otherwise(markup(k)))), "")
    return F.when(F.contains(body, F.lit("<")), mixed).otherwise(unescape(body))


def read_turns(formatted: Column, attachments: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, restored."""
    pieces = F.split(formatted, CLOSE.replace("\n", "\\n"), -1)
    body = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))

    def parse(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), restored(F.substring(x, F.length(role) + 2, F.length(x)), attachments).alias("text"))

    return F.transform(body, parse)


def loss_text(blocks: Column, spans: Column, attachments: Column) -> Column:
    """All text under the loss mask, restored, nothing between; the formatted text comes in blocks."""
    return F.array_join(F.transform(spans, lambda s: restored(piece(blocks, s["start"], s["end"]), attachments)), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all read back from the formatted text, and what is attached."""
    wide = formatted.withColumn("blocks", text_blocks(F.col("formatted")))
    wide = wide.withColumns({"read": read_turns(F.col("formatted"), F.col("attachments")), "lost": loss_text(F.col("blocks"), F.col("loss_spans"), F.col("attachments"))})
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return wide.select(
        F.col("conv").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def conversations(df: DataFrame) -> DataFrame:
    """The formatted conversations of a table ``conv_id, turn, role, text``."""
    return format_turns(df, quoted("conv_id"), quoted("turn"), quoted("role"), markup_parts(F.coalesce(quoted("text"), F.lit(""))))
