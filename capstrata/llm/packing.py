"""Packing of examples into sequences by vector bin packing with the dot-product heuristic.

Each sequence has limits on three things at once: tokens, segments and loss-bearing tokens. An open sequence takes the
waiting example whose needs have the largest dot product with what the sequence has left (each as a share of its
limit, weighted). If none fits, an example is cut to what is left. Partitions are packed independently and as a
stream: a bounded pool of examples waits, so memory does not grow with the input. What a partition has left at its end
is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import read_table

#: Ends each document.
END_ID = 1
#: Examples that wait for a place in a partition.
POOL = 192
#: Sequence numbers of one partition.
PER_PARTITION = 1 << 36
VOCABULARY = "byte_bpe_50k"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("a sequence holds one token, segment and loss-bearing token at least")


#: Of instruction data at most half of a sequence bears loss, so that batches have an even share of it.
INSTRUCTION = Limits(loss_tokens=1024)


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Ids of a text by a public byte-level vocabulary, as its tokenizer file gives them without added ids.

    So the string of an added token in a text is that token. The rank file gives the same ids as the tokenizer file of
    the same vocabulary, at a quarter of the CPU time.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json")) as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    coder = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: coder.encode(text, allowed_special="all") if any(t in text for t in added) else coder.encode_ordinary(text)


@dataclass
class Example:
    """What is left to place of one example: its ids from `start` on, and which of them bear loss (None: all)."""

    key: object
    ids: np.ndarray
    start: int
    total: int
    loss: np.ndarray | None = None

    @property
    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, length: int) -> Example:
        """The first ids as a piece of their own; the rest stays."""
        piece = Example(self.key, self.ids[:length], self.start, self.total, None if self.loss is None else self.loss[:length])
        self.ids, self.start = self.ids[length:], self.start + length
        if self.loss is not None:
            self.loss = self.loss[length:]
        return piece

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest head with at most so many tokens and loss-bearing tokens."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(self.loss[:n]), loss, side="right"))


def pack_stream(examples: Iterator[Example], limits: Limits = Limits(), pool: int = POOL) -> Iterator[list[Example]]:
    """Sequences, each a list of pieces, for a stream of examples. Examples without ids get no piece."""
    top = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    waiting: list[Example] = []
    needs = np.zeros((pool, 3))
    more = True

    def fill() -> Iterator[list[Example]]:
        nonlocal more
        while more and len(waiting) < pool:
            example = next(examples, None)
            if example is None:
                more = False
                return
            while len(example.ids) >= limits.tokens and example.fitting(limits.tokens, limits.loss_tokens) == limits.tokens:
                yield [example.cut(limits.tokens)]
            if len(example.ids):
                needs[len(waiting)] = (len(example.ids), 1, example.loss_tokens)
                waiting.append(example)

    def take(i: int) -> Example:
        example = waiting[i]
        last = len(waiting) - 1
        waiting[i], needs[i] = waiting[last], needs[last]
        waiting.pop()
        return example

    yield from fill()
    while waiting:
        total = needs[: len(waiting)].sum(axis=0)
        if not more and total[0] <= limits.tokens and total[1] <= limits.segments and total[2] <= limits.loss_tokens:
            yield from _tail([take(0) for _ in range(len(waiting))])
            return
        left, bin_ = top.copy(), []
        while left[0] > 0 and left[1] > 0 and waiting:
            have = needs[: len(waiting)]
            fits = (have <= left).all(axis=1)
            if fits.any():
                weight = left / top / top  # needs and what is left, both as shares of the limits
                i = int(np.argmax(np.where(fits, have @ weight, -1.0)))
                piece = take(i)
            else:
                # cut the one that most exceeds what is left, so that its rest stays a useful size
                i = int(np.argmax(have[:, 0]))
                length = waiting[i].fitting(int(left[0]), int(left[2]))
                if length == 0:
                    i = next((k for k in range(len(waiting)) if waiting[k].fitting(int(left[0]), int(left[2]))), -1)
                    if i < 0:
                        break
                    length = waiting[i].fitting(int(left[0]), int(left[2]))
                if length == len(waiting[i].ids):
                    piece = take(i)
                else:
                    piece = waiting[i].cut(length)
                    needs[i] = (len(waiting[i].ids), 1, waiting[i].loss_tokens)
            bin_.append(piece)
            left -= (len(piece.ids), 1, piece.loss_tokens)
        yield bin_
        yield from fill()


def _tail(rest: list[Example]) -> Iterator[list[Example]]:
    """The last examples in sequences whose lengths are powers of two."""
    size = sum(len(e.ids) for e in rest)
    rest = rest[::-1]
    while size:
        room, bin_ = 1 << (size.bit_length() - 1), []
        size -= room
        while room:
            if len(rest[-1].ids) <= room:
                bin_.append(rest.pop())
            else:
                bin_.append(rest[-1].cut(room))
            room -= len(bin_[-1].ids)
        yield bin_


def pack_texts(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    docs: doc_id, text (null: empty) and any further columns, which are ignored. Every id of every row lies in exactly
    one piece; repeated rows are packed each for itself. Pieces of a sequence follow each other without gaps. A task
    that runs again packs its whole partition again, under the numbers of that partition.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        number = TaskContext.get().partitionId() * PER_PARTITION

        def examples() -> Iterator[Example]:
            for batch in it:
                keys, texts = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    ids = np.array([*encode(texts[i].as_py() or ""), END_ID], np.uint32)
                    yield Example(keys[i].as_py(), ids, 0, len(ids))

        rows: list[tuple] = []
        held = 0
        for sequence in pack_stream(examples(), limits):
            offset = 0
            for p in sequence:
                rows.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, offset, p.ids.astype(np.int32)))
                offset += len(p.ids)
            number += 1
            held += offset
            if held > 1 << 20:
                yield _pieces(rows)
                rows, held = [], 0
        if rows:
            yield _pieces(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, schema)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)), pa.array(np.concatenate(columns[7])))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), ids], names=names)


def pack_conversations(conversations: DataFrame, limits: Limits = INSTRUCTION, vocabulary: str = VOCABULARY) -> DataFrame:
    """Instruction data: the turns of a conversation are one example, and only assistants' tokens bear loss.

    conversations: conv_id, turn, role, text. Returns conv_id, start, length, loss_tokens, sequence_id, offset, ids.
    Turns are ordered by (turn, role, text); nulls are empty texts.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        number = TaskContext.get().partitionId() * PER_PARTITION

        def examples() -> Iterator[Example]:
            for batch in it:
                for key, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids, loss = [], []
                    for t in turns:
                        head, body = encode(t["role"] + "\n"), [*encode(t["text"]), END_ID]
                        ids += head + body
                        loss += [False] * len(head) + [t["role"] == "assistant"] * len(body)
                    yield Example(key, np.array(ids, np.uint32), 0, len(ids), np.array(loss, bool))

        for sequence in pack_stream(examples(), limits):
            offset, rows = 0, []
            for p in sequence:
                rows.append({"conv_id": p.key, "start": p.start, "length": len(p.ids), "loss_tokens": p.loss_tokens, "sequence_id": number, "offset": offset, "ids": p.ids.astype(np.int32).tolist()})
                offset += len(p.ids)
            number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_TURNS)

    return grouped.mapInArrow(batches, "conv_id long, start long, length long, loss_tokens long, sequence_id long, offset long, ids array<int>")


_TURNS = pa.schema([(c, pa.int64()) for c in ("conv_id", "start", "length", "loss_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without their ids. Every token of a document bears loss, so here the limit on those
    is the limit on tokens. Null and empty texts are their end id alone; repeated rows are packed each; no rows, no pieces.
    """
    return pack_texts(read_table(spark, sf_dir, "documents")).drop("ids")
