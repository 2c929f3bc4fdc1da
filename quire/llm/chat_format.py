r"""Chat formatting with budgeted windows, in built-in Spark functions only.

A turn becomes one marked piece of text.  Prefix sums of the turns' tokens cut a
conversation into spans of whole turns; every span after the first is preceded
by the system turn and by the last turns before it that fit the history budget,
whose targets are masked.  A window is the span with what is repeated before it.

Template: ``<s>`` starts a window; ``[SYS]..[/SYS]``, ``[INST]..[/INST]`` and
``[OUT]..</s>`` hold a system, user and assistant turn, ``[ROLE]role[TEXT]..[/ROLE]``
any other.  Inside texts and roles a control string gets a backslash after its
first character, and one with backslashes there gets one more, so that escaping
is reversible and no text can hold a control string: ``</s>`` is ``<\/s>``.

Tokens of a turn: words and single other characters of its text, and
``TURN_TOKENS`` for its marks.  A window is within the budget unless one turn or
the system turn alone is longer; turns are never cut.

Edge cases: null text and role are empty; rows of a conversation are ordered by
turn (nulls first), role, text; a null conv_id is a conversation; equal rows are
separate turns; an empty table gives an empty result; extra columns are ignored.
A conversation is one value of the result, so its turns come together in one
row; different conversations never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_BUDGET, HISTORY_TURNS, TURN_TOKENS = 1024, 128, 4, 4
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]"
_REST = r"/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|TEXT\]"
#: A turn of a formatted window; texts hold no control string, so the first end is the turn's own.
TURN = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|\[OUT\].*?</s>|\[ROLE\].*?\[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def marked_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: its place, marked text, and prefix sums of tokens and characters in its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long")).withColumn("body", escape(F.col("text")))
    head = (
        F.when(F.col("role") == "user", "[INST]").when(F.col("role") == "system", "[SYS]").when(F.col("role") == "assistant", "[OUT]")
        .otherwise(F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[TEXT]")))
    )
    tail = F.when(F.col("role") == "user", "[/INST]").when(F.col("role") == "system", "[/SYS]").when(F.col("role") == "assistant", "</s>").otherwise("[/ROLE]")
    rows = rows.withColumn("marked", F.concat(head, "body", tail)).withColumn("head", F.length(head)).withColumn("chars", F.length("marked").cast("long"))
    return rows.select(
        "conv_id", F.row_number().over(order).alias("i"), "role", "marked", "tokens", F.sum("tokens").over(so_far).alias("upto"), "chars",
        F.sum("chars").over(so_far).alias("chars_upto"), "head", F.length("body").alias("body"),
    )


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row for each window: ``conv_id``, ``window``, ``formatted``, ``n_turns``, ``n_repeated`` (turns at its
    start that an earlier window holds), ``n_tokens``, ``over_budget`` and ``loss_spans`` (code points of
    ``formatted`` under the loss: the new assistant texts)."""
    turns = marked_turns(conversations).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "role", "marked", "tokens", "upto", "chars", "chars_upto", "head", "body"))).alias("t")
    )
    turns = turns.selectExpr("conv_id", "t", "t[0].role = 'system' AS sys", "if(t[0].role = 'system', t[0].tokens, 0L) AS sys_tokens")
    starts = f"""aggregate(t, named_struct('s', array(1), 'base', sys_tokens),
        (a, x) -> if(x.i > element_at(a.s, -1) AND x.upto - a.base > {budget - history_budget} - sys_tokens,
                     named_struct('s', concat(a.s, array(x.i)), 'base', x.upto - x.tokens), a), a -> a.s)"""
    turns = turns.selectExpr("*", f"{starts} AS starts")
    # from: first repeated turn after the system turn; the empty history always fits
    plan = f"""transform(starts, (s, k) -> named_struct('k', k, 's', s, 'e', coalesce(get(starts, k + 1) - 1, size(t)), 'h',
        if(k = 0, s, array_min(filter(sequence(greatest(if(sys, 2, 1), s - {history_turns}), s),
            h -> t[s - 2].upto - coalesce(get(t, h - 2).upto, 0L) <= {history_budget}))), 'rep', k > 0 AND sys))"""
    turns = turns.selectExpr("*", f"{plan} AS plan")
    made = """transform(plan, p -> named_struct('window', p.k,
        'formatted', concat('<s>', if(p.rep, t[0].marked, ''), array_join(transform(slice(t, p.h, p.e - p.h + 1), x -> x.marked), '')),
        'n_turns', int(p.rep) + p.e - p.h + 1, 'n_repeated', int(p.rep) + p.s - p.h,
        'n_tokens', if(p.rep, t[0].tokens, 0L) + t[p.e - 1].upto - coalesce(get(t, p.h - 2).upto, 0L),
        'loss_spans', transform(filter(slice(t, p.s, p.e - p.s + 1), x -> x.role = 'assistant'), x -> named_struct(
            'start', 3 + if(p.rep, t[0].chars, 0L) + x.chars_upto - x.chars - coalesce(get(t, p.h - 2).chars_upto, 0L) + x.head,
            'end', 3 + if(p.rep, t[0].chars, 0L) + x.chars_upto - x.chars - coalesce(get(t, p.h - 2).chars_upto, 0L) + x.head + x.body))))"""
    return turns.selectExpr("conv_id", f"inline({made})").withColumn("over_budget", F.col("n_tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations that ``chat_windows`` formatted, from its output alone: one row for each, with
    ``n_turns``, ``turns`` (role, newline, text, newline for each turn), ``loss`` (all text under the mask,
    unescaped) and ``formatted_chars``."""
    def turn(x: Column) -> Column:
        role = F.when(x.startswith("[INST]"), "user").when(x.startswith("[SYS]"), "system").when(x.startswith("[OUT]"), "assistant")
        inner = F.regexp_extract(x, r"(?s)^\[[A-Z]+\](.*)(?:\[/[A-Z]+\]|</s>)$", 1)
        other = x.startswith("[ROLE]")
        at = F.instr(inner, "[TEXT]")
        role = F.when(other, unescape(F.left(inner, at - 1))).otherwise(role)
        return F.concat(role, F.lit("\n"), unescape(F.when(other, F.substr(inner, at + 6)).otherwise(inner)), F.lit("\n"))

    found = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    new = F.slice(found, F.col("n_repeated") + 1, F.greatest(F.size(found) - F.col("n_repeated"), F.lit(0)))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = windows.select("conv_id", F.struct(
        "window", F.array_join(F.transform(new, turn), "").alias("turns"), F.array_join(loss, "").alias("loss"),
        F.size(new).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
    ).alias("w"))
    w = F.array_sort(F.collect_list("w"))
    return rows.groupBy("conv_id").agg(
        F.sum("w.n").alias("n_turns"), F.array_join(F.transform(w, lambda x: x["turns"]), "").alias("turns"),
        F.array_join(F.transform(w, lambda x: x["loss"]), "").alias("loss"), F.sum("w.chars").alias("formatted_chars"),
    )
