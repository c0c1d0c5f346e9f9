"""Chat formatting with prefix-target expansion.

Each assistant turn is an example of its own: all turns before it are its context, and only its text is trainable. All
examples of a conversation are prefixes of one formatted text, so that text is stored once, a piece per turn, and an
example is where its prefix ends and where its target lies. A conversation of n turns then costs n rows, not n * n;
:func:`render` writes examples out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.staging import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Strings with a meaning to some tokenizer or template. In a text, a backslash is put behind the first character, and one
# more where there are any: taking one away gives the text back.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
TARGET = "assistant"
TURNS = "number bigint, role string, piece string, chars bigint, start bigint, body bigint"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def role_line(role: Column) -> Column:
    """The role in one line: backslashes doubled, line ends as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def read_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def _number(kind: pa.DataType) -> object:
    """Number turns and add up their lengths, conversation by conversation, within a sorted partition."""
    names = ["conv_id", "number", "role", "piece", "chars", "start", "body", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, last, number, start = context.partitionId() if context else 0, object(), 0, 0
        for batch in batches:
            numbers, starts = [], []
            for conv, chars in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if conv != last:
                    last, number, start = conv, 0, 0
                numbers.append(number)
                starts.append(start)
                number, start = number + 1, start + chars
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(kind),
                    pa.array(numbers, pa.int64()),
                    *[batch.column(i) for i in (1, 2, 3)],
                    pa.array(starts, pa.int64()),
                    batch.column(4),
                    pa.array([part] * batch.num_rows, pa.int64()),
                ],
                names=names,
            )

    return run


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces of formatted conversations: conv_id, ``number`` from 0, ``role``, ``piece``, its ``chars``, its
    ``start`` in the conversation's formatted text, and ``body``, where the turn's own text begins in the piece.

    Turns follow their number, NULL last; ties go by role and text, so repeated rows are turns one after the other. NULL
    roles and texts are empty; a NULL conversation is one of its own; other columns are ignored. Rows are range-partitioned
    on conversation and turn, so a conversation with most rows is cut; what lies before each cut is added from one row
    per conversation and partition.
    """
    plain_role, plain = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    header = F.concat(F.lit(OPEN), role_line(plain_role), F.lit("\n"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("_turn").asc_nulls_last(), "role", "piece"]
    pieces = (
        df.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).alias("_turn"),
            plain_role.alias("role"),
            F.concat(header, escape(plain), F.lit(CLOSE)).alias("piece"),
            F.length(header).cast("long").alias("body"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "piece", F.length("piece").cast("long").alias("chars"), "body")
    )
    spark = df.sparkSession
    kind = spark.createDataFrame([], pieces.select("conv_id").schema).toArrow().schema.field(0).type
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {TURNS}, part bigint"
    rows = staged(pieces.mapInArrow(_number(kind), schema), "turns")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        rows.groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
        .select(
            F.col("conv_id").alias("_conv"),
            F.col("part").alias("_part"),
            F.sum("n").over(before).alias("_numbers"),
            F.sum("chars").over(before).alias("_chars"),
        )
        .where("_numbers > 0")
    )
    # Conversations that go on in another partition: fewer rows than partitions.
    cut = staged(cut, "cut")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return rows.join(cut, same, "left").select(
        "conv_id",
        (F.col("number") + F.coalesce("_numbers", F.lit(0))).alias("number"),
        "role",
        "piece",
        "chars",
        (F.col("start") + F.coalesce("_chars", F.lit(0))).alias("start"),
        "body",
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its context is [0, context_chars) of the conversation's formatted text, the example
    [0, chars), and the loss mask covers [loss_start, loss_end) alone."""
    return turns.where(F.col("role") == TARGET).select(
        "conv_id",
        "number",
        F.col("start").alias("context_chars"),
        (F.col("start") + F.col("body")).alias("loss_start"),
        (F.col("start") + F.col("chars") - len(CLOSE)).alias("loss_end"),
        (F.col("start") + F.col("chars")).alias("chars"),
    )


def render(turns: DataFrame) -> DataFrame:
    """Examples written out: conv_id, number, ``text``, loss_start, loss_end. Each repeats its whole context, so the
    output grows with the square of a conversation's turns, and a task holds one example's text."""
    targets = examples(turns).drop("context_chars", "chars").withColumnRenamed("number", "target").withColumnRenamed("conv_id", "_conv")
    joined = turns.join(targets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("number") <= F.col("target")))
    pieces = F.array_join(F.array_sort(F.collect_list(F.struct("number", "piece")))["piece"], "")
    return joined.groupBy("conv_id", F.col("target").alias("number"), "loss_start", "loss_end").agg(pieces.alias("text"))


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the formatted pieces and the examples alone.

    ``n_examples``, ``examples_chars`` (of all examples, each with its whole context) and ``examples_sha256``: of every example
    in order its context's length, the digest of its context, its length and its target's formatted text.
    Conversations are streamed in order through tasks that hold one hash at a time, however long a conversation is.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    loss = examples(turns).select(
        F.col("conv_id").alias("_conv"), F.col("number").alias("_number"), "loss_start", "loss_end", "context_chars", F.col("chars").alias("example_chars")
    )
    # The spans come from the same staged rows; joining them to their turn is by conversation and number.
    spanned = turns.join(loss, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("number") == F.col("_number")), "left")
    ordered = (
        spanned.select(
            "conv_id",
            "number",
            "piece",
            (F.col("loss_start") - F.col("start")).alias("from"),
            (F.col("loss_end") - F.col("start")).alias("to"),
            "context_chars",
            "example_chars",
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "number")
    )
    arrow = turns.sparkSession.createDataFrame([], turns.select("conv_id").schema).toArrow().schema.field(0).type
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "examples_chars", "examples_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        last, state = object(), None

        def close() -> None:
            if state is not None:
                done.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6], state[7].hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            kinds = [arrow, *[pa.int64(), pa.string()] * 2, *[pa.int64()] * 3, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for conv, _, piece, begin, end, context, chars in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != last:
                    close()
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                head, _, body = piece[len(OPEN) : -len(CLOSE)].partition("\n")
                state[0] += 1
                state[1].update(f"{read_role(head)}\n{unescape(body)}\n".encode())
                state[4] += len(piece)
                if begin is not None:
                    target = unescape(piece[begin:end])
                    state[2] += len(target)
                    state[3].update(target.encode())
                    state[5] += 1
                    state[6] += chars
                    state[7].update(f"{context} {state[8].hexdigest()} {chars} {piece[begin:end]}\n".encode())
                state[8].update(piece.encode())
            yield flush()
            done.clear()
        close()
        yield flush()

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema += ", n_examples bigint, examples_chars bigint, examples_sha256 string"
    return ordered.mapInArrow(digest, schema)
