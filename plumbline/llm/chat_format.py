"""Chat formatting as a relational job: conversations from rows of turns, in Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one
run by array aggregation; runs are concatenated. A conversation reads

    <s> [INST]role[/INST]text[NEXT]text</s> [INST]role[/INST]text</s> ...

without the blanks: ``[INST]role[/INST]`` opens a run, ``[NEXT]`` stands between the turns of a run, ``</s>`` closes it. Inside
texts and roles a control string gets a backslash after its first character, and one more if it has some already, so that no
control string is left and taking one off restores the text. A control string holds ``<`` or ``[`` at its first
character only, hence none can arise where a text and a mark meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the template
BEGIN, OPEN, SHUT, NEXT, END = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
CONTROL = r"([<\[])(\\*(?:/?s>|/?INST\]|NEXT\]))"
ESCAPED = r"([<\[])\\(\\*(?:/?s>|/?INST\]|NEXT\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def runs_of(turns: Column) -> Column:
    """Sorted turns as runs ``(role, texts)``: a run begins where the role differs from the turn before.

    The beginnings are found first and each run is a slice, so the work is linear in the turns.
    """
    at = F.sequence(F.lit(1), F.size(turns))
    begins = F.filter(at, lambda k: (k == 1) | (F.get(turns, k - 1)["role"] != F.get(turns, k - 2)["role"]))
    return F.transform(
        F.arrays_zip(begins.alias("lo"), F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(turns) + 1)).alias("hi")),
        lambda run: F.struct(
            F.get(turns, run["lo"] - 1)["role"].alias("role"),
            F.transform(F.slice(turns, run["lo"], run["hi"] - run["lo"]), lambda t: t["text"]).alias("texts")))


def segments_of(runs: Column, loss_roles: Sequence[str]) -> Column:
    """The pieces of the output in order, each with whether it is under the loss mask."""
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_run(run: Column) -> Column:
        trained = run["role"].isin(*loss_roles) if loss_roles else F.lit(False)
        head = F.concat(F.lit(OPEN), escape(run["role"]), F.lit(SHUT))
        texts = F.flatten(F.transform(run["texts"], lambda t, k: F.array(
            piece(F.when(k > 0, F.lit(NEXT)).otherwise(head), F.lit(False)), piece(escape(t), trained))))
        return F.concat(texts, F.array(piece(F.lit(END), F.lit(False))))

    return F.concat(F.array(piece(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform(runs, of_run)))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans`` per conversation; a span is (start, length) in code points of ``formatted``, one per text of a loss role.

    Null texts and roles are empty. Turns are ordered by turn, then role, then text, a null turn first; repeated
    rows are turns of their own. Rows without a conversation form one. Other columns are left out. Empty input gives an empty result.
    A conversation is one row of the result, so it must fit in a row; conversations are never cut.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = (turns.select(F.col(id_col).alias("conv_id"), row.alias("row"))
           .groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns")))
    out = out.select("conv_id", runs_of(F.col("turns")).alias("runs"))
    out = out.select("conv_id", segments_of(F.col("runs"), loss_roles).alias("segments"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, seg: Column) -> Column:
        n = F.length(seg["text"])
        spans = F.when(seg["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), n.alias("length")))).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), spans.alias("spans"))

    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                      F.aggregate("segments", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` that a formatted conversation holds."""
    blocks = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def of_block(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 2**31 - 1), SHUT, 1)
        body = block.substr(F.length(role) + len(OPEN + SHUT) + 1, F.length(block))
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted conversations hold: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    read = conversations.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                                read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")
