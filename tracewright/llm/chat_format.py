"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor flattens the parts of each turn (text, image, audio, document) in order. Text parts are
escaped, so that no control string can occur inside them; the other kinds become placeholders,
their references are recorded, and the tokens they expand to are counted from their sizes.

Escape: wherever "<", any number of backslashes and "|" follow each other, one more backslash goes
before the "|"; so "<|" never occurs in an escaped text, and taking one backslash away undoes it.

Output of format_chat, a row per conversation: conv_id, n_turns, formatted, loss_spans (0-based turn, then
start and length in code points inside that turn's piece, counted from its start mark), attachments
(ordinal, turn, kind, ref, tokens), attachment_tokens. The mask covers assistant texts alone.

Defined results: null text is empty, null role is empty, a null or empty list of parts is a turn without
content, parts of an unknown kind are an empty text. Turns sort by (turn, role, text), nulls first; repeated
rows are repeated turns; rows with a null conv_id form one conversation. Extra columns are not read. Very long texts are formatted whole.
A conversation is one output row, so its turns meet in one task; conversations are dealt by conv_id, and one
whose formatted text passes the 2 GB that a value can hold fails the query rather than being cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
IMAGE_PATCH, AUDIO_TOKENS_PER_S, TOKENS_PER_PAGE = 28, 25, 256
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(col):
    return F.regexp_replace(col, r"<(\\*)\|", r"<$1\\|")


def unescape(col):
    return F.regexp_replace(col, r"<\\(\\*)\|", "<$1|")


def escape_role(col):
    """A role is one line: backslash and line end are escaped besides the control strings."""
    return F.replace(F.replace(escape(col), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(col):
    back = F.replace(F.replace(F.replace(col, F.lit("\\\\"), F.lit("\\\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))
    return unescape(back)


def text_parts(text):
    """One text part, for tables with a plain text column."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(p):
    """Tokens that an attachment expands to; 0 for texts and for sizes that are not given."""
    up = lambda n: F.ceil(n / F.lit(IMAGE_PATCH))
    n = (
        F.when(p["kind"] == "image", up(p["width"]) * up(p["height"]))
        .when(p["kind"] == "audio", F.ceil(p["seconds"] * F.lit(AUDIO_TOKENS_PER_S)))
        .when(p["kind"] == "document", p["pages"] * F.lit(TOKENS_PER_PAGE))
    )
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


def visit(p):
    """A part as it stands in the formatted text."""
    out = F.coalesce(escape(p["text"]), F.lit(""))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(p["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """Formats rows (conv_id, turn, role, parts); parts is an array of PART structs."""
    is_text = lambda p: ~F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False))
    flat = F.transform(
        F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")),
        lambda p: F.struct(visit(p).alias("s"), is_text(p).alias("is_text"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), flat.alias("flat"))
    rows = rows.withColumn("body", F.array_join(F.transform("flat", lambda x: x["s"]), ""))
    spans = F.aggregate(
        "flat",
        F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["s"])).alias("at"),
            F.when(x["is_text"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(x["s"]).alias("length"))))).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
            F.when(F.col("role") == "assistant", spans).otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
            F.transform(F.filter("flat", lambda x: ~x["is_text"]), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("att"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    loss = F.flatten(F.transform("ts", lambda t, i: F.transform(t["spans"], lambda s: F.struct(i.alias("turn"), s["start"].alias("start"), s["length"].alias("length")))))
    att = F.flatten(F.transform("ts", lambda t, i: F.transform(t["att"], lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return convs.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        loss.alias("loss_spans"),
        F.transform(att, lambda a, i: F.struct(i.alias("ordinal"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_chat(chats: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, turns (role, text; placeholders stay in it), loss_text, formatted."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    df = chats.withColumn("pieces", F.slice(pieces, F.lit(2), F.size(pieces)))

    def turn(p):
        nl = F.locate("\n", p) if isinstance(p, str) else F.instr(p, F.lit("\n"))
        return F.struct(
            unescape_role(F.substring(p, F.lit(1), nl - 1)).alias("role"),
            unescape(F.substring(p, nl + 1, F.length(p) - nl - F.lit(len(END) + 1))).alias("text"),
        )

    masked = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.concat(F.lit(START), F.element_at("pieces", s["turn"] + 1)), s["start"] + 1, s["length"])),
    )
    return df.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))
