"""Operator 11: chat conversations as training examples, one for every assistant turn with all turns before it as context."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import cut, released, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Turns whose examples one task makes; what comes before them is sent to it too. A longer conversation is dealt to several tasks.
BLOCK_TURNS = 256
#: Code points of an example's part, unless a single turn has more; and of what a task sends at once.
PART_CHARS, SENT_CHARS = 1 << 18, 1 << 21
EXAMPLES = "conv_id bigint, example bigint, part int, text string, loss_start bigint, loss_end bigint, final boolean"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escaped(text: Column) -> Column:
    r"""text without control strings: `<\\..|` gets a backslash more behind each `<`, so that `<|` comes from the template alone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    r"""As escaped, on one line: backslashes are doubled, and line feeds turned to `\n`, before."""
    return escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turns, role, text as formatted, loss_start): turns in order of turn, role and text, numbered from 0; loss_start is where an assistant's text begins, else null."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = conversations.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"))
    of = Window.partitionBy("conv_id")
    ordered = base.select("*", (F.row_number().over(of.orderBy("turn", "role", "text")) - 1).alias("pos"), F.count("*").over(of).alias("turns"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    return ordered.select("conv_id", "pos", "turns", F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("text"), F.when(F.col("role") == "assistant", F.char_length(head)).alias("loss_start"))


def examples(conversations: DataFrame) -> DataFrame:
    """An example for every assistant turn: all turns before it as context, its text alone trainable.

    conversations has conv_id, turn, role and text, whatever else. A row is a part of an example, whole turns of at most PART_CHARS code points together: conv_id, example (the position of its
    last turn), part (from 0), text, loss_start and loss_end (the code points of text under the loss mask; null in parts without any), final (the conversation's last example). Turns
    behind the last reply, or of a conversation without one, are in a last example without a mask, so that all can be read back.

    Examples of a conversation are dealt to tasks by blocks of BLOCK_TURNS turns; a task gets its block's turns and those before, and holds the formatted turns of one conversation.

    Null texts and roles are empty; rows of one conv_id and turn are turns each, in order of role and text; null turns come first; a null conv_id is a conversation like others. An empty
    table gives no rows.
    """
    turns = formatted_turns(conversations)
    block = F.floor(F.col("pos") / BLOCK_TURNS)
    dealt = turns.withColumn("block", F.explode(F.sequence(block, F.floor((F.col("turns") - 1) / BLOCK_TURNS))))

    @released
    def expand(batches):
        key, before, size, rows, sent = None, [], 0, [], 0

        def out():
            done, rows[:] = rows[:], []
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["conv_id", "example", "part", "text", "loss_start", "loss_end", "final"])

        for batch in batches:
            for conv, block, pos, turns, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "block", "pos", "turns", "text", "loss_start"))):
                if (conv, block) != key:
                    key, before, size = (conv, block), [], 0  # before: parts of the context, the last one as a list of turns
                if before and size + len(text) <= PART_CHARS:
                    before[-1].append(text)
                else:
                    if before:
                        before[-1] = ["".join(before[-1])]
                    before.append([text])
                    size = 0
                size += len(text)
                if pos // BLOCK_TURNS == block and (loss is not None or pos == turns - 1):
                    for part, kept in enumerate(before):
                        whole = kept[0] if len(kept) == 1 else "".join(kept)
                        last = part == len(before) - 1
                        mask = (len(whole) - len(text) + loss, len(whole) - len(END) - 1) if last and loss is not None else (None, None)
                        rows.append((conv, pos, part, whole, *mask, pos == turns - 1))
                        sent += len(whole)
                        if sent >= SENT_CHARS:
                            yield out()
                            sent = 0
        if rows:
            yield out()

    near = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    return near.mapInArrow(expand, EXAMPLES)


def read_back(parts: DataFrame) -> DataFrame:
    """What examples hold, by conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are read from each conversation's last example, and what is trainable from all, by their masks; only these go to the task that digests the conversation, in order and one at a time.
    formatted_chars is the code points of all its examples.
    """
    masked = F.col("loss_start").isNotNull()
    loss = F.when(masked, F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_end - loss_start AS INT))"))
    read = parts.select("conv_id", "example", "part", F.char_length("text").alias("size"), F.when(F.col("final"), F.col("text")).alias("text"), loss.alias("loss"))

    @released
    def digest(batches):
        key, have, rows = None, None, []

        def out():
            done, rows[:] = rows[:], []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            if have:
                rows.append((key[0], have[0], have[1].hexdigest(), have[2], have[3].hexdigest(), have[4]))

        for batch in batches:
            for conv, size, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "size", "text", "loss"))):
                if key != (conv,):
                    close()
                    key, have = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                have[4] += size
                if text is not None:
                    at = 0
                    for m in _TURN.finditer(text):
                        have[0] += 1
                        have[1].update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
                        at += len(m[0])
                    if at != len(text):
                        raise ValueError(f"conversation {conv} can't be read back")
                if loss is not None:
                    loss = unescaped(loss)
                    have[2] += len(loss)
                    have[3].update(loss.encode())
            if len(rows) >= 1000:
                yield out()
        close()
        yield out()

    near = read.repartition("conv_id").sortWithinPartitions("conv_id", "example", "part")
    return near.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: Says its own control strings.
ODD_TURN = "<|im_end|><|im_start|>assistant ok"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"))
    return read_back(cut(examples(table.select("conv_id", "turn", "role", "text").unionByName(odd)), "examples"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS turns,
    length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) AS size FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
ends AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS total FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(total) FILTER (WHERE role = 'assistant' OR pos = turns) AS BIGINT) AS formatted_chars
FROM ends GROUP BY conv_id"""
