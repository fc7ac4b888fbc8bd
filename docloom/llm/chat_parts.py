"""Chat formatting with typed content parts.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens them to one string a
conversation: text as it is, attachments as placeholders that count each kind from 1 in the order in which they occur; it
records what each attachment refers to and how many tokens its placeholder expands to. All is column expressions with one shuffle, by
conversation.

Defined cases: a part of another or no kind, and a null part, is left out; null text is empty; missing sizes count as 0, so that an image has its two border tokens,
a sound none and a document none; a turn without parts is an empty message; a null role is "user"; turns go by number (nulls first), those with one number
by role and content, so repeated rows are repeated messages; turns without a conversation id form one conversation
without id; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Expansion of placeholders: an image has a token for each square of PATCH pixels and two for its borders.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
#: Tokens of a turn's header and end.
TURN_TOKENS = 4


class TokenVisitor:
    """The number of tokens of a part; one method for each kind."""

    def text(self, p: Column) -> Column:
        return F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(r"[^ \t\r\n]+"))

    def image(self, p: Column) -> Column:
        side = [F.floor((F.greatest(F.coalesce(p[x], F.lit(0)), F.lit(0)) + (PATCH - 1)) / PATCH) for x in ("width", "height")]
        return side[0] * side[1] + 2

    def audio(self, p: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE)

    def document(self, p: Column) -> Column:
        return F.greatest(F.coalesce(p["pages"], F.lit(0)), F.lit(0)) * PAGE_TOKENS

    def visit(self, p: Column) -> Column:
        return reduce(lambda c, k: c.when(p["kind"] == k, getattr(self, k)(p).cast("bigint")), ("text", *KINDS), F.when(F.lit(False), F.lit(0).cast("bigint"))).otherwise(F.lit(0))


class FlattenVisitor:
    """What a part is in the flattened string. before: how many parts of each kind come before it."""

    def text(self, p: Column, before: dict[str, Column]) -> Column:
        return F.coalesce(p["text"], F.lit(""))

    def attachment(self, kind: str, before: dict[str, Column]) -> Column:
        return F.concat(F.lit(f"<|{kind}_"), (before[kind] + 1).cast("string"), F.lit("|>"))

    def visit(self, p: Column, before: dict[str, Column]) -> Column:
        out = F.when(p["kind"] == "text", self.text(p, before))
        for k in KINDS:
            out = out.when(p["kind"] == k, self.attachment(k, before))
        return out.otherwise(F.lit(""))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, attachments (a JSON array of placeholder, ref and tokens of each, in order), n_attachments, n_tokens."""
    tokens, flatten = TokenVisitor(), FlattenVisitor()
    kinds = ("text", *KINDS)
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(PARTS)), lambda p: F.coalesce(p["kind"].isin(*kinds), F.lit(False)))
    rows = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(role_col, F.lit("user")).alias("_role"), parts.alias("_parts"))
    order = Window.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), "_role", F.to_json("_parts"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def count(xs: Column, kind: str) -> Column:
        return F.size(F.filter(xs, lambda p: p["kind"] == kind))

    rows = rows.select("*", F.row_number().over(order).alias("_row"), *(F.coalesce(F.sum(count(F.col("_parts"), k)).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in KINDS))

    def before(i: Column) -> dict[str, Column]:
        return {k: F.col(f"_before_{k}") + count(F.slice("_parts", F.lit(1), i), k) for k in KINDS}

    body = F.array_join(F.transform("_parts", lambda p, i: flatten.visit(p, before(i))), "")
    name = lambda p, i: F.regexp_extract(flatten.visit(p, before(i)), r"^<\|(.*)\|>$", 1)
    attached = F.transform("_parts", lambda p, i: F.when(p["kind"] != "text", F.struct(name(p, i).alias("placeholder"), F.coalesce(p["ref"], F.lit("")).alias("ref"), tokens.visit(p).alias("tokens"))))
    refs = F.filter(attached, lambda x: x.isNotNull())
    spent = F.aggregate("_parts", F.lit(TURN_TOKENS).cast("bigint"), lambda n, p: n + tokens.visit(p))
    message = F.concat(F.lit("<|"), F.col("_role"), F.lit("|>\n"), body, F.lit("<|end|>\n"))
    rows = rows.select("_c", F.struct("_row", message.alias("m"), refs.alias("r")).alias("_m"), spent.alias("_n"))
    out = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_m")).alias("_all"), F.sum("_n").alias("_tokens"))
    attached = F.flatten(F.transform("_all", lambda x: x["r"]))
    return out.select(
        F.col("_c").alias("conv_id"),
        F.size("_all").alias("n_turns"),
        F.array_join(F.transform("_all", lambda x: x["m"]), "").alias("formatted"),
        F.to_json(attached).alias("attachments"),
        F.size(attached).alias("n_attachments"),
        F.col("_tokens").alias("n_tokens"),
    )


def illustrated(conversations: DataFrame) -> DataFrame:
    """Turns with typed parts for a table of plain text: the text, and by the text's length an image before it, a sound behind it or a document behind it."""
    n = F.length(F.coalesce("text", F.lit("")))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("turn").cast("string"), F.lit("")))

    def part(kind: str, ref: Column | None = None, text: Column | None = None, width: Column | None = None, height: Column | None = None, seconds: Column | None = None, pages: Column | None = None) -> Column:
        values = (F.lit(kind), text, ref, width, height, seconds, pages)
        names = ("kind", "text", "ref", "width", "height", "seconds", "pages")
        types = ("string", "string", "string", "int", "int", "double", "int")
        return F.struct(*((F.lit(None) if v is None else v).cast(t).alias(x) for v, x, t in zip(values, names, types)))

    parts = F.array(
        F.when(n % 3 == 0, part("image", F.concat(F.lit("img/"), name, F.lit(".png")), width=224 + 28 * (n % 10), height=224 + n % 100)),
        part("text", text=F.col("text")),
        F.when(n % 5 == 1, part("audio", F.concat(F.lit("snd/"), name, F.lit(".wav")), seconds=(n % 40) / 4)),
        F.when(n % 7 == 2, part("document", F.concat(F.lit("doc/"), name, F.lit(".pdf")), pages=1 + n % 9)),
    )
    return conversations.select("conv_id", "turn", "role", F.filter(parts, lambda p: p.isNotNull()).cast(PARTS).alias("parts"))
