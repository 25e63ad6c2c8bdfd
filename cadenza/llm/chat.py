"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable. What
follows the last assistant turn trains nothing and comes as one record of its own (`target` null), so that the output
holds every turn. A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`; inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so a control string in a text can never be read as one, and reading back is exact.

A conversation is gathered once, linear in its size; the expansion happens row by row as the examples are generated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: Text per Arrow batch of examples, in characters.
BATCH_CHARS = 4 << 20


def _escaped(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


EXAMPLE = "conv_id long, target int, n_context int, text string, loss_start long, loss_end long"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "target", "n_context", "text", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    held, chars = [], 0

    def flush():
        nonlocal held, chars
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
        held, chars = [], 0

    for batch in batches:
        for conv, turns in zip(batch["conv_id"].to_pylist(), batch["turns"]):
            pieces, done = [], 0
            for k, turn in enumerate(turns.as_py()):
                head, body = f"{START}{turn['role']}\n", turn["text"]
                if turn["role"] == "assistant":
                    context = "".join(pieces)
                    at = len(context) + len(head)
                    held.append((conv, k, k, f"{context}{head}{body}{STOP}\n", at, at + len(body)))
                    chars, done = chars + len(held[-1][3]), k + 1
                    if chars > BATCH_CHARS:
                        yield from flush()
                pieces.append(f"{head}{body}{STOP}\n")
            if done < len(pieces):
                rest = "".join(pieces[done:])
                held.append((conv, None, 0, rest, None, None))
                chars += len(rest)
                if chars > BATCH_CHARS:
                    yield from flush()
    yield from flush()


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target, n_context, text, loss_start, loss_end) of (conv_id, turn, role, text).

    `target` is the place of the trainable turn, `loss_start` and `loss_end` its span in `text` in code points. Turns are
    ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. A null text or role counts
    as empty; a null conv_id is a conversation like any other. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\n")).alias("role"), _escaped(F.col("text")).alias("text"),
    ).alias("one"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return whole.mapInArrow(_expand, EXAMPLE)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(STOP, line)
        out.append((unescape(text[at + len(START): line]), unescape(text[line + 1: stop])))
        at = stop + len(STOP) + 1
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each record adds to its conversation: its own last turns, its trainable text, its length."""
    for batch in batches:
        rows = []
        for conv, target, text, a, b in zip(*(batch[k].to_pylist() for k in ("conv_id", "target", "text", "loss_start", "loss_end"))):
            rows.append((conv, target, read_turns(text), unescape(text[a:b]) if target is not None else None, len(text)))
        spoken = [[f"{r}\n{t}\n" for r, t in x[2]] for x in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([len(x) for x in spoken], pa.int64()),
            pa.array(["".join(x) for x in spoken], pa.string()), pa.array([x[3] for x in rows], pa.string()), pa.array([x[4] for x in rows], pa.int64()),
        ], names=["conv_id", "target", "n", "spoken", "loss", "chars"])


def digests(records: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from `examples`."""
    wide = "conv_id long, target int, n long, spoken string, loss string, chars long"
    read = records.select("conv_id", "target", "text", "loss_start", "loss_end").mapInArrow(_read, wide)
    last = F.max_by(F.struct("n", "spoken"), F.when(F.col("target").isNotNull(), F.col("target")))
    rest = F.max_by(F.struct("n", "spoken"), F.when(F.col("target").isNull(), F.lit(1)))
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))), lambda x: x["loss"]), "")
    both = read.groupBy("conv_id").agg(last.alias("last"), rest.alias("rest"), losses.alias("loss"), F.sum("chars").alias("formatted_chars"))
    said = F.concat(F.coalesce(F.col("last.spoken"), F.lit("")), F.coalesce(F.col("rest.spoken"), F.lit("")))
    return both.select(
        "conv_id", (F.coalesce(F.col("last.n"), F.lit(0)) + F.coalesce(F.col("rest.n"), F.lit(0))).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
