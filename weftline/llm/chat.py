"""Chat formatting by token-level assembly.

Each segment of a turn is encoded by itself and the control tokens are spliced in as reserved ids
beyond the vocabulary, so no text can produce one. In the text form a control string inside a
content is escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, save, sent, table
from .encoder import encoder, id_type
from .packing import tokenizer_path

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """Put one more backslash into each `<`, backslashes, `|`: no control string is left."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def _role(text: str) -> str:
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _rows(batches, columns: list[str]):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _flush(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _chunks(rows, fields, most: int = 2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _flush(held, fields)
            held = []
    yield _flush(held, fields)


def assemble(conversations: DataFrame, tokenizer: str, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, seq (its place), position (ids of the conversation before it), ids, mask.

    A conversation's formatted form is its rows' ids in order, in the narrowest type that holds them. mask
    is 1 on the content ids of roles that are learnt from, from the prefix sums of +1 where such a
    content begins and -1 where it ends. Turns come by turn number, nulls first, ties by role and then
    text; a null role or text is empty, a null conv_id is a conversation too, and repeated rows are turns
    of their own. Encoding runs before rows are brought together, only ids travel (and the texts of tied
    turns), and a conversation is never held as a whole. Rows of a conversation lie in one partition, in
    order. Other columns are ignored; an empty table gives no rows.
    """
    ready(conversations.sparkSession)
    pieces = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("ids", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tied = rows.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = save(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.lit(True).alias("tied")), "tied")
    if tied.isEmpty():
        rows = rows.withColumn("tied", F.lit(False))
    else:
        rows = rows.join(sent(tied), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")), "left").drop("c", "t", "r")

    def encode(batches):
        enc = encoder(tokenizer)
        kind = id_type(enc.size + 2)
        start, end = (np.array([enc.size + k], kind).tobytes() for k in (0, 1))
        wide = lambda x: np.frombuffer(x, enc.dtype).astype(kind).tobytes()
        newline = wide(enc.encode(["\n"])[0])
        for b in batches:
            for lo in range(0, len(b), 512):
                part = list(zip(*(b.column(c).slice(lo, 512).to_pylist() for c in ("conv_id", "turn", "role", "text", "tied")), strict=True))
                heads = enc.encode([_role(r[2]) + "\n" for r in part])
                bodies = enc.encode([escape(r[3]) for r in part])
                rows = []
                for r, h, t in zip(part, heads, bodies, strict=True):
                    h, t = wide(h), wide(t)
                    at = 1 + len(h) // kind.itemsize
                    rows.append((*r[:3], r[3] if r[4] else None, start + h + t + end + newline, at, at + len(t) // kind.itemsize))
                yield _flush(rows, pieces)

    out = [("conv_id", pa.int64()), ("seq", pa.int64()), ("position", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())]

    def join(batches):
        size = id_type(encoder(tokenizer).size + 2).itemsize

        def rows():
            conv, seq, position, first = None, 0, 0, True
            for c, role, ids, lo, hi in _rows(batches, ["conv_id", "role", "ids", "lo", "hi"]):
                if first or c != conv:
                    conv, seq, position, first = c, 0, 0, False
                n = len(ids) // size
                step = np.zeros(n + 1, np.int8)
                if role in learn_roles:
                    step[lo] += 1
                    step[hi] -= 1
                yield c, seq, position, ids, np.cumsum(step[:-1], dtype=np.int8).tobytes()
                seq, position = seq + 1, position + n

        yield from _chunks(rows(), out)

    encoded = rows.select("conv_id", "turn", "role", "text", "tied").mapInArrow(encode, "conv_id long, turn long, role string, tie string, ids binary, lo long, hi long")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("turn", "tie")
    return ordered.mapInArrow(join, "conv_id long, seq long, position long, ids binary, mask binary")


def read_back(formatted: DataFrame, tokenizer: str, placed: bool = False) -> DataFrame:
    """Turns, learnt text and lengths of each conversation, read from the assembled ids and masks alone. placed: the rows lie as assemble leaves them."""
    ready(formatted.sparkSession)
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64())]

    def run(batches):
        enc = encoder(tokenizer)
        start, end, kind = enc.size, enc.size + 1, id_type(enc.size + 2)
        table_ = enc.token_bytes()
        text_of = lambda ids: b"".join(table_[i] for i in ids.tolist()).decode()

        def rows():
            conv, state = None, None
            for c, ids, mask in _rows(batches, ["conv_id", "ids", "mask"]):
                if state is None or c != conv:
                    if state is not None:
                        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                a, m = np.frombuffer(ids, kind), np.frombuffer(mask, np.int8)
                opens, shuts = np.flatnonzero(a == start), np.flatnonzero(a == end)
                for lo, hi in zip(opens.tolist(), shuts.tolist(), strict=True):
                    head, _, body = text_of(a[lo + 1 : hi]).partition("\n")
                    state[0] += 1
                    state[1].update(f"{_role_back(head)}\n{unescape(body)}\n".encode())
                    state[4] += len(START) + len(head) + 1 + len(body) + len(END)
                    learnt = unescape(text_of(a[lo:hi][m[lo:hi] == 1]))
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                outside = len(a) - int((shuts - opens + 1).sum())
                state[4] += outside  # the line ends after turns
                state[5] += len(a)
            if state is not None:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

        yield from _chunks(rows(), fields)

    ordered = formatted if placed else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(assemble(rows, tokenizer_path()), tokenizer_path(), placed=True)
