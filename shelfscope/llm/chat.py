"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A visitor flattens it:
text parts are written with control strings escaped, every other part leaves one placeholder at its
place, and an attachment record says where the content lies and how many tokens it expands to.

Template, for each turn in order:  <|im_start|>ROLE NEWLINE BODY <|im_end|> NEWLINE
Placeholder:                       <|KIND|>, KIND one of image, audio, document; other for the rest

Escaping is reversible: inside texts and roles a backslash is put before the bar of every
`<|`, `<\\|`, `<\\\\|` and so on, so that no control string can arise from a text; taking one
backslash away gives the text back. In roles, `%` and line ends are written %25 and %0A.

The loss mask covers the body of each assistant turn (its text parts), as spans of code points.

As texts hold no unescaped control string, read_back() tells placeholders from texts that look like
them, and gives the parts back in their order.

Null texts and roles count as empty; so does a null part, and a null list of parts has none. A part
without kind is text. A kind that isn't known leaves the placeholder <|other|>, and its own name
stands in the attachment record alone. Null turns come first. Rows of one turn number are ordered by
role and content. Conversations with null id form one. A conversation becomes one row, as large as
itself; no other state is kept for it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm import scratch

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
#: Tokens that one unit of an attachment expands to, and the least of any: an image's units are
#: its 14 x 14 patches, an audio clip's are milliseconds, a document's are pages.
TOKENS = {"image": (0.25, 1), "audio": (0.025, 1), "document": (1024.0, 1)}
OTHER = "other"
_PLACEHOLDER = re.compile(rf"<\|({'|'.join([*TOKENS, OTHER])})\|>")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def text_part(c: Column) -> Column:
    """A plain text as a list of one part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(c, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("units")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def joined_texts(parts: Column) -> Column:
    """Parts with their numbers, texts that follow each other joined to one, so that no control
    string arises where two of them meet."""
    kind = "struct<kind:string,text:string,ref:string,units:long,part:int>"
    numbered = F.transform(parts, lambda p, i: F.struct(F.coalesce(p["kind"], F.lit("text")).alias("kind"), F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).alias("text"), p["ref"].alias("ref"), p["units"].alias("units"), i.alias("part")).cast(kind))

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(last["kind"].alias("kind"), F.concat(last["text"], p["text"]).alias("text"), last["ref"].alias("ref"), last["units"].alias("units"), last["part"].alias("part")).cast(kind)
        meet = (F.size(acc) > 0) & F.coalesce(last["kind"] == "text", F.lit(False)) & is_text(p)
        return F.when(meet, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(numbered, F.expr(f"CAST(array() AS array<{kind}>)"), add)


def visit(part: Column) -> Column:
    """What a part leaves in the body."""
    written = escape(F.coalesce(part["text"], F.lit("")))
    kind = F.when(part["kind"].isin(list(TOKENS)), part["kind"]).otherwise(OTHER)
    return F.when(is_text(part), written).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def expanded(part: Column) -> Column:
    """The tokens that a part's placeholder stands for."""
    out = F.lit(1).cast("long")
    for kind, (rate, least) in TOKENS.items():
        out = F.when(part["kind"] == kind, F.greatest(F.lit(least), F.ceil(F.coalesce(part["units"], F.lit(0)) * rate)).cast("long")).otherwise(out)
    return out


def render(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, parts. Returns for each conversation conv_id, formatted, loss
    (spans of code points), attachments (turn_number, part, placeholder number in the conversation,
    kind, ref, tokens) and attachment_tokens."""
    turns = turns.withColumn("parts", joined_texts(F.coalesce("parts", F.expr(f"CAST(array() AS {PARTS})"))))
    role = escape(F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))
    pieces = F.transform("parts", visit)
    rows = turns.withColumn("head", F.concat(F.lit(START), role, F.lit("\n"))).withColumn("body", F.array_join(pieces, ""))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("trained", F.coalesce(F.col("role") == train_role, F.lit(False)))
    # Where each text part stands in the body: the lengths of the pieces before it, added up.
    lengths = F.transform("parts", lambda p: F.struct(is_text(p).alias("text"), F.length(visit(p)).alias("n")))
    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,size:int>>)").alias("spans"))
    placed = F.aggregate(
        lengths,
        first,
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["text"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["n"].alias("size"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    rows = rows.withColumn("texts", F.when(F.col("trained"), placed).otherwise(F.expr("CAST(array() AS array<struct<start:int,size:int>>)")))
    marks = F.filter(F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"), is_text(p).alias("plain"))), lambda m: ~m["plain"])
    rows = rows.withColumn("marks", marks)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("number", F.row_number().over(order))
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0))).withColumn("before", F.coalesce(F.sum(F.size("marks")).over(ahead), F.lit(0)))
    rows = rows.select(
        "conv_id",
        F.struct(
            "number",
            "piece",
            F.transform("texts", lambda s: F.struct((F.col("start") + F.length("head") + s["start"]).alias("start"), s["size"].cast("long").alias("size"))).alias("loss"),
            F.transform("marks", lambda m, i: F.struct(F.col("number").alias("turn_number"), m["part"].alias("part"), (F.col("before") + i + 1).alias("placeholder"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens"))).alias("marks"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    attachments = F.flatten(F.col("ts.marks"))
    return whole.select(
        "conv_id",
        F.array_join("ts.piece", "").alias("formatted"),
        F.flatten("ts.loss").alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("attachment_tokens"),
    )


def _parts(body: str) -> list[dict]:
    """A body's parts in order: texts unescaped, placeholders by their kind."""
    cut = _PLACEHOLDER.split(body)  # texts and kinds by turns
    out = [{"kind": "text", "text": unescape(x)} if k % 2 == 0 else {"kind": x, "text": None} for k, x in enumerate(cut)]
    return [p for p in out if p["text"] != ""]


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses render()'s output: conv_id, turns (role, parts of kind and text, and text: that of its
    text parts joined), loss_text (all text under the mask, unescaped) and formatted_chars."""
    part = pa.struct([("kind", pa.string()), ("text", pa.string())])
    turn = pa.struct([("role", pa.string()), ("parts", pa.list_(part)), ("text", pa.string())])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses, chars = [], [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                own = []
                for piece in text.split(START)[1:]:
                    role, body = piece.removesuffix(END).split("\n", 1)
                    parts = _parts(body)
                    own.append({"role": unescape(role).replace("%0A", "\n").replace("%25", "%"), "parts": parts, "text": "".join(p["text"] or "" for p in parts)})
                turns.append(own)
                losses.append("".join(unescape(text[s["start"] : s["start"] + s["size"]]) for s in spans or []))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, pa.list_(turn)), pa.array(losses, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turns", "loss_text", "formatted_chars"])

    scratch.small_batches(formatted.sparkSession)
    schema = "conv_id long, turns array<struct<role:string,parts:array<struct<kind:string,text:string>>,text:string>>, loss_text string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(parse, schema)


def digests(back: DataFrame) -> DataFrame:
    """The read-back conversations in short: turn and loss digests and sizes."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
