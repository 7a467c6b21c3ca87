"""Chat formatting [native]: budgeted windows of whole turns, with a loss mask.

Turns of a conversation are put in order and measured, and a window function gives the
prefix sums of their sizes. These cut them into spans of whole turns that fit the token
budget. Each window repeats the system turn (the first turn, if its role is ``system``)
and up to ``history`` turns before its span, as far as the budget allows. The loss mask
covers the texts of assistant turns of the span alone: repeated ones are masked.

The budget counts words and marks, not the ids of some tokenizer: SQL functions can't run
one. A caller whose tokenizer makes more of a word gives a smaller budget.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and roles
a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control
string; in roles a line break becomes ``\\n``. :func:`unescape` undoes both.

Defined results: null texts and roles are empty; null turns come first; equal turn
numbers are ordered by role, then text; repeated rows are turns of their own; a
turn larger than the budget gets a window that exceeds it, never cut; a null
conversation id is a conversation; an empty table gives an empty table; other columns are
not read, so no name clashes. The turns of one conversation are gathered in one row, as its
digests are of the whole of it in order; the work is in proportion to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    """As :func:`unescape`; ``\\n`` that isn't after an odd backslash becomes a line break."""
    broken = F.regexp_replace(role, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n")
    return unescape(broken)


def turn_tokens(text: Column) -> Column:
    """Size of a turn: its words and marks, and three for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")) + 3


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 2, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, windows``.

    A window is ``text``, ``repeated`` (how many of its first turns were in a
    window before), ``n_turns``, ``tokens`` and ``spans`` of the loss mask (start and
    length in code points of the window's text).
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), by.alias("role"), said.alias("text")).withColumn("n", turn_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # prefix sums: p is the size of the turns before
    rows = rows.select("conv_id", "role", "text", "n", F.row_number().over(order).alias("i"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("p"))
    row = F.struct("i", "role", "n", "p", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    out = out.withColumn("_sys", F.expr("IF(_t[0].role = 'system', 1, 0)"))
    out = out.withColumn("_room", F.expr(f"{budget} - IF(_sys = 1, _t[0].n, 0)"))
    # first turn of each span: greedy over the prefix sums, the first span beginning at the system turn; a list that grows is copied, so cuts are kept in blocks
    out = out.withColumn("_cut", F.expr("""aggregate(sequence(0, size(_t) - 1), struct(0 AS a, array(0) AS block, cast(array() AS array<array<int>>) AS full),
        (s, i) -> IF(i > s.a AND _t[i].p + _t[i].n - _t[s.a].p > _room + IF(s.a = 0 AND _sys = 1, _t[0].n, 0),
            struct(i AS a, IF(size(s.block) < 256, array_append(s.block, i), array(i)) AS block, IF(size(s.block) < 256, s.full, array_append(s.full, s.block)) AS full), s),
        s -> flatten(array_append(s.full, s.block)))"""))
    # of each span: its end, and how many turns before it are repeated within the budget
    out = out.withColumn("_spans", F.expr(f"""transform(_cut, (a, k) -> struct(a AS a, coalesce(get(_cut, k + 1), size(_t)) AS b,
        IF(k = 0, 0, size(filter(sequence(1, {history}), h -> a - h >= _sys AND _t[coalesce(get(_cut, k + 1), size(_t)) - 1].p + _t[coalesce(get(_cut, k + 1), size(_t)) - 1].n - _t[greatest(a - h, 0)].p <= _room))) AS h,
        IF(k > 0, _sys, 0) AS s))""" if history > 0 else "transform(_cut, (a, k) -> struct(a AS a, coalesce(get(_cut, k + 1), size(_t)) AS b, 0 AS h, IF(k > 0, _sys, 0) AS s))"))
    out = out.withColumn("_w", F.expr("transform(_spans, x -> struct(x.h + x.s AS repeated, concat(slice(_t, 1, x.s), slice(_t, x.a - x.h + 1, x.b - x.a + x.h)) AS t))"))
    # places of the texts in a window: prefix sums of code points, folded from left to right
    tail = len(END) + 1
    out = out.withColumn("windows", F.expr(f"""transform(_w, w -> struct(
        array_join(transform(w.t, x -> concat(x.head, x.body, '{END}\n')), '') AS text, w.repeated AS repeated, size(w.t) AS n_turns,
        aggregate(w.t, 0, (s, x) -> s + x.n) AS tokens,
        aggregate(w.t, struct(0L AS at, 0 AS i, cast(array() AS array<struct<start:bigint,length:bigint>>) AS spans),
            (s, x) -> struct(s.at + char_length(x.head) + char_length(x.body) + {tail} AS at, s.i + 1 AS i,
                IF(s.i >= w.repeated AND x.role = 'assistant', array_append(s.spans, struct(s.at + char_length(x.head) AS start, cast(char_length(x.body) AS bigint) AS length)), s.spans) AS spans),
            s -> s.spans) AS spans))"""))
    return out.select("conv_id", F.size("_t").cast("long").alias("n_turns"), "windows")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts parsed from the windows' own texts: ``conv_id, windows, turns, losses``."""
    # every turn mark begins a piece; the pieces that a window repeats are left out
    pieces = F.expr(f"flatten(transform(windows, w -> slice(split(w.text, '{_quoted(START)}'), w.repeated + 2, w.n_turns - w.repeated)))")
    out = formatted.withColumn("_pieces", pieces)
    cut = len(END) + 1
    out = out.withColumn("turns", F.transform("_pieces", lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.char_length(x) - F.instr(x, "\n") - cut)).alias("text"))))
    out = out.withColumn("losses", F.flatten(F.transform("windows", lambda w: F.transform(w["spans"], lambda s: unescape(F.substring(w["text"], (s["start"] + 1).cast("int"), s["length"].cast("int")))))))
    return out.drop("_pieces")


def _quoted(mark: str) -> str:
    """A control string as a regular expression inside a SQL literal."""
    return "".join(f"[{c}]" if c in "|<>" else c for c in mark)


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w["text"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )
