"""Best-fit packing of whole documents, certified by lower bounds.

A document is cut only where it is longer than a sequence. Pieces are packed in blocks, the partitions of the table or
parts of them: best-fit decreasing, then a lower bound on the number of sequences that any packing of the block needs,
the largest that a set of dual feasible functions gives. A block that meets its bound is certified; it gives away the
emptiest of its sequences only, the share by which its bound was rounded up. A block with a gap gives away the pieces
of all sequences that are not full. What was given away is dealt out anew, so that blocks exchange documents, and packed
again; the new packing counts if it takes fewer sequences. Only lengths move: ids stay where they were written.
"""

from __future__ import annotations

import operator
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import cut, in_parts, new_folder, read_table

#: Ends each document; the most tokens of a sequence.
END_ID, TOKENS = 0, 2048
VOCABULARY = "word_bpe_49k"
#: Pieces that are packed together, and the most times that pieces are exchanged.
BLOCK, ROUNDS = 1 << 16, 8
#: Words whose ids a worker remembers until it begins anew, keeping those that it meets again, and the longest of them.
_KNOWN, _LONGEST = 1 << 19, 40
#: Rows that one task may number, and sequences of one task and round.
_ROWS, _SEQUENCES = 1 << 40, 1 << 34

# What the vocabulary's tokenizer does to text without other characters than these: white space parts words, A-Z is
# lower-cased, and words fall into contractions, runs of letters, digits and runs of other marks.
_USUAL = re.compile("[!-~¡¿«»À-ÿ–—…‘’“”]+")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_BLANK = re.compile("[\x20\x09-\x0d]+")


class Memory(dict):
    """What was made of the words that a worker has met of late, as many as `most` twice; what is new comes from `make`."""

    def __init__(self, make: Callable[[str], bytes], most: int = _KNOWN):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= _LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizer file of a lower-casing word vocabulary gives them, without added ids.

    No token reaches over white space, so words are looked up among those that a worker has seen; a new one of usual
    characters is taken apart, and its parts are looked up and else given to the tokenizer's model. Words with other
    characters go through the whole tokenizer. A test holds the ids equal to those of the tokenizer on whole texts.
    """
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    model, added = tokenizer.model, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # the usual characters beyond ASCII, as the model's alphabet of bytes spells them
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    beyond = {i: spell(chr(i))[0][0] for i in range(128, 0x2030) if _USUAL.fullmatch(chr(i))}
    tokenize, id_of = model.tokenize, operator.attrgetter("id")

    def of_part(part: str) -> bytes:
        tokens = tokenize(part if part.isascii() else part.translate(beyond))
        return struct.pack(f"<{len(tokens)}I", *map(id_of, tokens))

    def whole(word: str) -> bytes:
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    parts = Memory(of_part)

    def of_word(word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return parts[word.lower()]
            usual = word.isprintable()
        else:
            usual = _USUAL.fullmatch(word)
        if not usual or "<" in word and any(a in word for a in added):
            return whole(word)
        return b"".join([parts[part] for part in _PARTS.findall(word.lower())])

    words = Memory(of_word)

    found = words.__getitem__

    def encode(text: str) -> np.ndarray:
        # characters at which Python parts words, but the tokenizer does not
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        each = filter(None, _BLANK.split(text)) if odd else text.split()
        return np.frombuffer(b"".join(map(found, each)), "<u4")

    return encode


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def _kept_encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """One encoder for all tasks of a worker, with what it remembers."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = encoder(vocabulary)
    return _encoders[vocabulary]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of counts[x] items of each size x (0 to capacity) can go below.

    A dual feasible function maps sizes so that what fits a bin still does; so the mapped sizes over the mapped capacity
    are a bound. Three families are tried: one that drops items below a size and takes for whole what then stands alone,
    one that rounds to k-ths, and one that counts multiples of a size, up for items over half a bin and down for others.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    k = counts[sizes].astype(np.int64)
    best = -(-int((k * sizes).sum()) // capacity)
    least = np.arange(1, capacity // 2 + 1)
    items, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    items[sizes + 1], total[sizes + 1] = k, k * sizes
    items, total = np.cumsum(items), np.cumsum(total)  # of those smaller than a size
    alone, among = items[-1] - items[capacity - least + 1], total[capacity - least + 1] - total[least]
    best = max(best, int((-(-(capacity * alone + among) // capacity)).max(initial=0)))
    for parts in range(1, 33):
        whole, rest = np.divmod((parts + 1) * sizes, capacity)
        best = max(best, -(-int((k * np.where(rest == 0, parts * sizes, whole * capacity)).sum()) // (parts * capacity)))
    for some in np.array_split(least, max(1, len(least) // 128)):
        step = some[:, None]
        if not len(some):
            continue
        up = 2 * (capacity // step - (capacity - sizes) // step)
        mapped = np.where(2 * sizes > capacity, up, np.where(2 * sizes == capacity, capacity // step, 2 * (sizes // step)))
        best = max(best, int((-(-(mapped @ k) // (2 * (capacity // some)))).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, what each bin has left): the longest first, each to the fullest bin that it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they have left
    some, left = 0, []  # bit r of some: whether there are bins with r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = some >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(0)
        bins[i], offsets[i], left[b] = b, capacity - room, room - length
        if room > length:
            waiting[room - length].append(b)
            some |= 1 << room - length
    return bins, offsets, np.array(left, np.int64)


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(bin, offset and whether it is given away for each piece; number of bins; its lower bound)."""
    bins, offsets, left = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if len(left) > bound:
        given = left > 0
    else:
        given = np.zeros(len(left), bool)
        if len(left) and left.max() > 0:
            given[left.argmax()] = True
    return bins, offsets, given[bins], len(left), bound


def _packed(rows: DataFrame, turn: int, capacity: int, block: int) -> DataFrame:
    """(key, length, sequence_id, offset, given, block, bins, bound) of the pieces (key, length), packed in blocks of each task."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = turn << 58 | TaskContext.get().partitionId() * _SEQUENCES
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            lengths = rows["length"].to_numpy()
            bins, offsets, given, n, bound = pack_block(lengths, capacity)
            whole = [np.full(len(lengths), x, np.int64) for x in (number, n, bound)]
            columns = [rows["key"].to_numpy(), lengths, number + bins, offsets, given, *whole]
            number += n
            if number - first > _SEQUENCES:
                raise OverflowError("a task has more sequences than it may number")
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "length", "sequence_id", "offset", "given", "block", "bins", "bound"])

        for batch in it:
            for start in range(0, batch.num_rows, block):
                held.append(batch.slice(start, block))
                if sum(b.num_rows for b in held) >= block:
                    table = pa.Table.from_batches(held)
                    yield packed(table.slice(0, block))
                    held = table.slice(block).to_batches()
        if held:
            yield packed(pa.Table.from_batches(held))

    return cut(rows.select("key", "length").mapInArrow(batches, "key long, length long, sequence_id long, offset long, given boolean, block long, bins long, bound long"))


def assign(pieces: DataFrame, capacity: int = TOKENS, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(key, sequence_id, offset, block, bins, bound) of pieces (key long, distinct; length long, 1 to capacity).

    block names where a piece was packed last, bins and bound that block's sequences and how many it needs at least.
    Exchanges end when none is left to exchange with, when they save nothing, or after `rounds`; the packing is whole at
    any time. Tasks hold one block.
    """
    placed, kept = _packed(pieces, 0, capacity, block), []
    for turn in range(1, rounds + 1):
        loose = placed.where("given")
        n, before, blocks = loose.agg(F.count("*"), F.count_if(F.col("offset") == 0), F.count_distinct("block")).first()
        if blocks < 2:
            break
        again = _packed(loose.repartition(-(-n // block), F.xxhash64("key", F.lit(turn))), turn, capacity, block)
        if again.where("offset = 0").count() >= before:
            break
        kept.append(placed.where("not given"))
        placed = again
    for part in kept:
        placed = placed.unionByName(part)
    return placed.drop("length", "given")


def cut_pieces(docs: DataFrame, capacity: int = TOKENS, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32, ids) of each piece of docs (doc_id, text), written once in the shared folder."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _kept_encoder(vocabulary)
        key = TaskContext.get().partitionId() * _ROWS
        for batch in in_parts(it, 256):
            rows, made = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((key, doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                    made.append(part)
                    key += 1
            columns = list(zip(*rows, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[4])]).astype(np.int32)), pa.array(np.concatenate(made).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)), lists], names=["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = new_folder(docs.sparkSession, "pieces")
    rows.mapInArrow(batches, "key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack_whole(docs: DataFrame, capacity: int = TOKENS, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row for each piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, block, bins, bound, ids.

    docs: doc_id, text (null: empty) and any further columns, which are ignored. A document is its ids and the end id;
    only one of more than `capacity` is cut, at multiples of it. Repeated rows are packed each. No rows: no pieces.
    """
    pieces = cut_pieces(docs, capacity, vocabulary, end_id)
    found = pieces.join(assign(pieces, capacity, block), "key")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "block", "bins", "bound", "ids")


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without their ids. Null and empty texts are their end id alone; repeated rows are
    packed each; no rows, no pieces.
    """
    return pack_whole(read_table(spark, sf_dir, "documents")).drop("block", "bins", "bound", "ids")
