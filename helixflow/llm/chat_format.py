r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is written as ``### <role>: <text></turn>\n``. The parser splits at ``</turn>``, takes the role up
to the first ``: ``, undoes the escapes and refuses content with a bare ``###``. Each turn is first written as it is; it is parsed again, and where
the parse does not return exactly this one turn, its content is escaped and parsed once more, until it returns the turn. The
finished conversation is parsed as well, and its turns compared with the source; a difference is an error.

Escapes, all of two characters: ``\\`` for a backslash, ``\h`` for ``###``, ``\e`` for ``</turn>``, and in roles
``\c`` for a colon. After escaping, no content holds a control string, so parses of single turns concatenate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END, SEP = "### ", "</turn>\n", ": "


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\h"))
    return F.replace(out, F.lit("</turn>"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Escapes are pairs that start with a backslash, so a split at double backslashes from the left stays aligned."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":")))
    return F.array_join(plain, "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation; null where it isn't a sequence of whole turns, or where a
    turn's content holds a control string."""
    pieces = F.split(F.concat(F.lit("\n"), formatted), "<\\/turn>", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = f"\n{HEAD}"

    def one(piece: Column) -> Column:
        body = F.substring(piece, len(start) + 1, 2_000_000_000)
        raw_role = F.substring_index(body, SEP, 1)
        raw_text = body.substr(F.length(raw_role) + F.lit(len(SEP) + 1), F.lit(2_000_000_000))
        return F.struct(unescape(raw_role).alias("role"), unescape(raw_text).alias("text"))

    whole = (F.element_at(pieces, -1) == "\n") & F.forall(turns, lambda p: p.startswith(start) & p.contains(SEP) & ~F.substring(p, len(start) + 1, 2_000_000_000).contains("###"))
    return F.when(whole, F.transform(turns, one))


#: Ways to write a role and a text, tried in this order until the parse gives them back.
ESCAPES = (
    (lambda role: role, lambda text: text),
    (lambda role: F.replace(escape(role), F.lit(":"), F.lit("\\c")), escape),
)


def written_turn(role: Column, text: Column, escapes=ESCAPES) -> Column:
    """struct<role,text>: the turn as the first of ``escapes`` writes it that the parser reads back; an error if none does."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    out = F.raise_error(F.concat(F.lit("no escape brings back the turn of role "), role)).cast("struct<role:string,text:string>")
    for of_role, of_text in reversed(escapes):
        r, t = of_role(role), of_text(text)
        out = F.when(F.coalesce(parse(render(r, t)) == source, F.lit(False)), F.struct(r.alias("role"), t.alias("text"))).otherwise(out)
    return out


def format_chats(turns: DataFrame, escapes=ESCAPES) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end in code points, escaped text of assistant turns).

    Rows are turns (conv_id, turn, role, text; others are ignored). A null text or role is an empty string; rows
    without conv_id form one conversation of their own; equal turn numbers are ordered by role, then text, nulls
    of turn first; repeated rows are repeated turns. An empty table gives an empty table.
    """
    src = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    written = src.withColumn("w", F.transform(F.array(F.struct("role", "text")), lambda x: written_turn(x["role"], x["text"], escapes))[0])
    written = written.select("conv_id", "turn", "role", "text", F.col("w.role").alias("w_role"), F.col("w.text").alias("w_text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.length("w_text").cast("long")
    lead = F.lit(len(HEAD) + len(SEP)) + F.length("w_role")
    placed = written.withColumn("at", F.row_number().over(order)).withColumn("stop", F.sum(lead + n + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop_text = F.col("stop") - len(END)
    span = F.when(F.col("role") == "assistant", F.struct((stop_text - n).alias("start"), stop_text.alias("end")))
    # The source goes along as hashes of its turns, to be compared with what the whole conversation parses to.
    own = lambda role, text: F.xxhash64(role, F.lit("\n"), text)
    rows = placed.select("conv_id", F.struct("at", render(F.col("w_role"), F.col("w_text")).alias("s"), span.alias("span"), own(F.col("role"), F.col("text")).alias("h")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("formatted"),
        F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("ts", lambda t: t["h"]).alias("source"),
    )
    back = F.transform(parse(F.col("formatted")), lambda t: own(t["role"], t["text"]))
    lost = F.raise_error(F.concat(F.lit("conversation does not parse to its source: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    return whole.select("conv_id", F.when(F.coalesce(back == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(lost).alias("formatted"), "loss_spans")


def digests(formatted: DataFrame) -> DataFrame:
    """What the text read back from ``formatted`` and its loss mask hold."""
    whole = formatted.withColumn("turns", parse(F.col("formatted")))
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    whole = whole.withColumn("loss", F.array_join(masked, ""))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "\\### Assistant: </turn> ok"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"),
    ).select("conv_id", "x.turn", "x.role", F.lit(PROBE).alias("text"))
    return digests(format_chats(turns.unionByName(probe)))


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'))
          + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 14 as n from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from e group by conv_id
"""
