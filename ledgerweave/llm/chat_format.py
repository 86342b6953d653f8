"""Reply trees as training conversations: root-to-leaf paths by self-joins, the best ones formatted.

1. Doubling: a message's table of jumps is joined with itself on the message
   that it jumps to, so the k-th table leads 2^k messages up. It ends when no
   message jumps any more: after as many joins as the depth has binary digits.
2. Paths: leaves take the jumps from the longest to the shortest or leave
   them, which gives each message above a leaf once, with its distance.
3. Branches are ranked by the scores of their messages; the first of each tree
   are formatted, turn by turn, and their turns are joined into parts of
   bounded size.

The format: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In texts and
roles, `<`, any number of backslashes and `|` get one backslash more, so that
no control string is left in them; taking one away gives the text back. A line
break in a role is written `<|nl|>`, which no escaped role has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch

START, END, NEW_LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Code points of a part, about; a part has whole turns.
PART_CHARS = 1 << 20
#: Role whose texts are learned.
LEARNED = "assistant"


def escaped(col):
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def chained(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without branches as messages: conv, id (place by turn), parent (the one before), score (null), role, text.

    Turns that are null come last; rows of the same turn go by role and text.
    """
    order = Window.partitionBy(conv_col).orderBy(F.asc_nulls_last(turn_col), role_col, text_col)
    rows = rows.select(F.col(conv_col).alias("conv"), F.row_number().over(order).cast("long").alias("id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(None).cast("double").alias("score"), "role", "text")


def jumps(edges: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables key, id, up, low: the k-th leads 2^k messages up; low is the least id among those passed, the last one included.

    With a cycle there is no end; the doubling stops when 2^k exceeds the number of messages.
    """
    most, out = edges.count(), []
    step = edges.select("key", "id", "up", F.col("up").alias("low")).filter("up is not null")
    while True:
        step = scratch.save(step, f"{name}-{len(out)}")
        if step.isEmpty():
            return out
        out.append(step)
        if 1 << (len(out) - 1) > most:
            return out
        over = step.select("key", F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        step = step.join(over.hint("merge"), ["key", "up"]).select("key", "id", F.col("next").alias("up"), F.least("low", "next_low").alias("low"))


def without_cycles(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The edges and their jumps; each cycle is cut at its smallest id, which becomes a root."""
    steps = jumps(edges, scratch, "jump")
    if steps and 1 << (len(steps) - 1) > edges.count():
        # Who still jumps is on a cycle or below one; only those on it meet themselves, the smallest first of all.
        cut = steps[-1].filter("id = low").select("key", "id", F.lit(True).alias("cut"))
        edges = edges.join(cut.hint("merge"), ["key", "id"], "left").select("key", "id", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "score")
        edges = scratch.save(edges, "cut")
        steps = jumps(edges, scratch, "again")
    return edges, steps


def paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """key, leaf, id, off: each message on the way from a leaf to its root, off messages above the leaf."""
    edges, steps = without_cycles(edges, scratch)
    parents = edges.filter("up is not null").select("key", F.col("up").alias("id")).distinct()
    found = edges.join(parents.hint("merge"), ["key", "id"], "left_anti").select("key", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("off"))
    for k in range(len(steps) - 1, -1, -1):
        found = scratch.save(found, f"paths-{k}")
        scratch.drop(f"paths-{k + 1}")
        above = found.join(steps[k].hint("merge"), ["key", "id"]).select("key", "leaf", F.col("up").alias("id"), (F.col("off") + (1 << k)).alias("off"))
        found = found.union(above)
    return found


def formatted_paths(messages: DataFrame, keep: int | None = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows conv, leaf, branch, score, part, text, spans: the formatted conversations of the chosen paths, cut into parts.

    messages: conv, id (long), parent (an id of the same conv, or null),
    score, role, text. A path's score is the sum of its messages' scores (null
    counts as 0); of each tree the first `keep` paths by score stay, equal ones
    by smaller leaf id, and branch is their rank from 1; None keeps all. The
    parts of a path, joined in order from 0, are the conversation; spans are
    the (start, end) code points within the part that are learned: the
    assistant's texts, as escaped, without the marks.

    A null conv is a conversation of its own; a null text or role is empty; a
    null id takes no part in a tree and is a path of its own, as are further
    rows of an id that occurs twice; a parent that isn't there makes a root; a
    cycle is cut at its smallest id. Very long texts stay whole within a part;
    an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "chat-format")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("key")
    rows = messages.select("conv", key, F.col("id").cast("long").alias("given"), F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.lit(START), F.replace(escaped("role"), F.lit("\n"), F.lit(NEW_LINE)), F.lit("\n"), escaped("text"), F.lit(f"{END}\n"))
    # Ids that are null or occur before get keys of their own.
    nth = F.row_number().over(Window.partitionBy("key", "given").orderBy("parent", F.desc("score"), "role", "text"))
    rows = rows.withColumn("nth", nth).withColumn("alone", F.col("given").isNull() | (F.col("nth") > 1))
    own_key = F.when(F.col("given").isNull(), F.concat(F.lit("?"), "nth", "key")).when(F.col("alone"), F.concat(F.lit("!"), "nth", "key")).otherwise(F.col("key"))
    rows = rows.select("conv", own_key.alias("key"), F.coalesce("given", F.lit(0)).alias("id"), F.when(~F.col("alone"), F.col("parent")).alias("parent"), "score", "role", turn.alias("turn"), F.char_length(escaped("text")).alias("chars"))
    rows = scratch.save(rows, "messages")

    there = rows.select("key", F.col("id").alias("parent"), F.col("id").alias("up"))
    edges = scratch.save(rows.select("key", "id", "parent", "score").join(there.hint("merge"), ["key", "parent"], "left").select("key", "id", "up", "score"), "edges")
    found = scratch.save(paths(edges, scratch).join(rows.select("key", "id", "score").hint("merge"), ["key", "id"]), "paths")
    scratch.drop("edges", "cut", "paths-0", *[f"{name}-{k}" for name in ("jump", "again") for k in range(64)])  # a depth has no more binary digits

    roots = found.groupBy("key", "leaf").agg(F.max_by("id", "off").alias("root"), F.max("off").alias("depth"), F.sum("score").alias("path_score"))
    ranked = roots.withColumn("branch", F.row_number().over(Window.partitionBy("key", "root").orderBy(F.desc("path_score"), "leaf")))
    chosen = ranked if keep is None else ranked.filter(F.col("branch") <= keep)

    turns = found.drop("score").join(chosen.hint("merge"), ["key", "leaf"]).withColumn("place", F.col("depth") - F.col("off"))
    turns = turns.join(rows.select("key", "id", "conv", "role", "turn", "chars").hint("merge"), ["key", "id"])
    so_far = Window.partitionBy("key", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("size", F.char_length("turn")).withColumn("at", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    turns = turns.withColumn("part", F.floor(F.col("at") / part_chars))
    first = F.min("at").over(Window.partitionBy("key", "leaf", "part"))
    stop = F.col("at") - first + F.col("size") - len(END) - 1
    turns = turns.withColumn("span", F.when(F.col("role") == LEARNED, F.struct((stop - F.col("chars")).alias("start"), stop.alias("end"))))
    parts = turns.groupBy("key", "leaf", "part").agg(
        F.first("conv").alias("conv"), F.first("branch").alias("branch"), F.first("path_score").alias("score"), F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("turns"),
    )
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull())
    return parts.select("conv", "leaf", "branch", "score", "part", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("text"), spans.alias("spans"))


class Reader:
    """Reads the parts of one formatted conversation, one after another."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[tuple[int, int]]) -> None:
        at = 0
        while at < len(text):
            if not text.startswith(START, at) or (stop := text.find(END, at)) < 0 or text[stop + len(END) : stop + len(END) + 1] != "\n":
                raise ValueError("not a formatted conversation")
            role, _, said = text[at + len(START) : stop].partition("\n")
            self.all.update(f"{unescaped(role.replace(NEW_LINE, '\n'))}\n{unescaped(said)}\n".encode())
            self.turns, at = self.turns + 1, stop + len(END) + 1
        for start, end in spans:
            said = unescaped(text[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_report(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row per formatted path, read back from its parts: conv, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A path's parts come to one task in order and are read one at a time, so
    its length doesn't matter. An empty table gives no rows.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    parts = formatted.select("conv", "leaf", "part", "text", "spans").repartition("conv", "leaf").sortWithinPartitions("conv", "leaf", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, done = None, None, []
        conv_type = None

        def rows() -> pa.RecordBatch:
            columns = [*zip(*done, strict=True)]
            kinds = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.column(0).type
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if reader is None or path != held:
                    if reader:
                        done.append((*held, *reader.row()))
                    held, reader = path, Reader()
                reader.read(batch.column(3)[i].as_py(), [(s["start"], s["end"]) for s in batch.column(4)[i].as_py()])
            if done:
                yield rows()
                done = []
        if reader:
            done = [(*held, *reader.row())]
            yield rows()

    names = [conv_col, "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return parts.mapInArrow(read, f"`{conv_col}` {kind}, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
