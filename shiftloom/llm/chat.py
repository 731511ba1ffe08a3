"""Chat formatting as relational work: turns are sorted, merged and concatenated by expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings of a conversation.

    A block of adjacent turns of one role is ``open role NEWLINE body text``, with ``NEWLINE more``
    before each further text of the block and ``NEWLINE close`` after the last. A control string
    never follows a backslash, except inside a text: there every control string and every reserved
    string gets one backslash in front, which reading back takes away.
    """

    open: str = "<|turn|>"
    body: str = "<|text|>"
    more: str = "<|more|>"
    close: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def pattern(self) -> str:
        """Matches each control or reserved string. None of them may hold a backslash or overlap another."""
        return "|".join(re.escape(x) for x in (self.open, self.body, self.more, self.close, *self.reserved))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self.pattern})", r"\\$1")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"\\({self.pattern})", "$1")

    def real(self, mark: str) -> str:
        """Matches ``mark`` where the template wrote it, not inside a text."""
        return rf"(?<!\\){re.escape(mark)}"


def running(numbers: Column) -> Column:
    """Sum of all numbers before each. An array that grows one by one is copied each time, so the sums are
    made in runs of about the square root of the length."""

    def sums(part: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    size = F.size(numbers)
    width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), width), lambda i: F.slice(numbers, i, width))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(parts, sums(totals, F.lit(0)), sums))


def format_chat(turns: DataFrame, template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``loss_spans`` (start and length in characters).

    ``turns`` has ``id_col``, turn, role and text, in any order; further columns are ignored. Rows
    are sorted by turn, then role, then text (null first), so ties have one order; repeated rows stay
    repeated. Null role or text: empty. Null id: a conversation of its own. An empty table gives no
    row. Adjacent turns of one role are merged into a block by array aggregation. The mask covers the
    escaped text of each turn of ``loss_roles`` and none of the control strings.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(id_col, F.struct(F.col("turn").alias("turn"), role.alias("role"), template.escape(text).alias("text")).alias("row_"))
    sorted_rows = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("row_")).alias("rows_"))

    rows_, roles, n = F.col("rows_"), F.col("roles_"), F.size("rows_")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(roles, i) != F.element_at(roles, F.greatest(i - 1, F.lit(1)))))
    laid_out = sorted_rows.select(id_col, rows_, F.transform(rows_, lambda r: r["role"]).alias("roles_"), F.transform(rows_, lambda r: r["text"]).alias("texts_"))
    begun = laid_out.select(id_col, "roles_", "texts_", starts.alias("starts_"))
    ends = F.concat(F.slice("starts_", 2, F.size("starts_")), F.array(F.size("roles_") + 1))
    blocks = begun.select(
        id_col,
        F.zip_with("starts_", ends, lambda s, e: F.struct(F.element_at("roles_", s).alias("role"), F.slice("texts_", s, e - s).alias("texts"))).alias("blocks_"),
    )

    def pieces(block: Column) -> Column:
        """Pieces of a block in order: control text, then turn text, alternating."""
        trained = block["role"].isin(*loss_roles)
        head = F.concat(F.lit(template.open), template.escape(block["role"]), F.lit("\n" + template.body))
        texts = F.transform(
            block["texts"],
            lambda t, i: F.struct(F.when(i == 0, head).otherwise(F.lit("\n" + template.more)).alias("mark"), t.alias("text"), trained.alias("loss")),
        )
        return F.concat(texts, F.array(F.struct(F.lit("\n" + template.close).alias("mark"), F.lit("").alias("text"), F.lit(False).alias("loss"))))

    laid = blocks.select(id_col, F.flatten(F.transform("blocks_", pieces)).alias("pieces_"))
    placed = laid.withColumn("at_", running(F.transform("pieces_", lambda p: F.length(p["mark"]) + F.length(p["text"]))))
    where = F.zip_with("pieces_", "at_", lambda p, at: F.struct((at + F.length(p["mark"])).alias("start"), F.length(p["text"]).alias("length"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(where, lambda w: w["loss"]), lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length")))
    joined = F.array_join(F.transform("pieces_", lambda p: F.concat(p["mark"], p["text"])), "")
    return placed.select(id_col, joined.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Turns of a formatted conversation: array of (role, text), as they were before merging."""
    blocks = F.slice(F.split(formatted, template.real(template.open)), 2, 1 << 30)

    def turns(block: Column) -> Column:
        halves = F.split(block, r"\n" + template.real(template.body), 2)
        body = F.split(F.element_at(halves, 2), r"\n" + template.real(template.close), 2)
        texts = F.split(F.element_at(body, 1), r"\n" + template.real(template.more))
        return F.transform(texts, lambda t: F.struct(template.unescape(F.element_at(halves, 1)).alias("role"), template.unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chat_query(conversations: DataFrame) -> DataFrame:
    """``op2_chat``: all conversations and conversation -1, digested from the formatted output."""
    spark, says = conversations.sparkSession, "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = format_chat(conversations.select("conv_id", "turn", "role", "text").unionByName(extra))
    back = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_T = Template()
_ESC = f"regexp_replace(%s, {_sql_text('(' + _T.pattern + ')')}, {_sql_text(chr(92) * 2 + chr(92) + '1')}, 'g')"

#: The same digests from the rows themselves, without formatting.
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS opens,
    length({_ESC % 'text'}) AS n_text, length({_ESC % 'role'}) AS n_role
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN opens = 1 THEN {len(_T.open) + 1 + len(_T.body) + 1 + len(_T.close)} + n_role ELSE {1 + len(_T.more)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
