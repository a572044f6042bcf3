"""Scoring of texts by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions. A node of the tree is a context (the last d bytes, d from 0 to
DEPTH) with the bits of the byte decided so far; it counts the zeros and ones that followed it in training texts and
estimates them by Krichevsky and Trofimov. The weighted probability of a node is the mean of its own estimate and of
the product of its children's, so a prediction mixes the estimates of all depths, each by what it has earned. The
score of a text is the sum of log10 of its bytes' probabilities; its code length per byte follows from that.

Work is split by blocks of documents and by parts of the tree. A block asks for the distinct byte runs that its texts
need, with their training counts (zero for those that only held-out texts have). The requests go up a tree of fan-in
FAN: at each level the lists of FAN groups meet, equal runs are merged and their counts added, and what comes out is
dealt to FAN times as many shelves by the next digit of a hash of the run's last three context bytes. So every group
sends FAN lists at most whatever the size of the corpus, lists stay as long as those of a block, and a shelf of the
last level is a part: all runs of its contexts, once. The nodes deeper than three bytes are weighted inside one task,
over the distinct runs of a part (at most 256**(DEPTH - 2) for each such context); shallower nodes are rows of
DataFrames. Answers go down the same tree, each list to those that it was merged from. Tokens for the base score travel
the same way. Nothing passes through the driver but three sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import cut, read_table

#: Bytes of context, and of those the depth down to which nodes are rows of DataFrames.
DEPTH, ROOTED = 5, 3
#: Bytes of text of a block.
BLOCK_BYTES = 12 << 20
#: Lists that meet in one group, and shelves that a group deals to.
FAN = 64
FOLDS, HELD_OUT = 7, 2
_END = b"\n"
_MASK = (1 << 8 * DEPTH) - 1
_LN2, _LOG10 = math.log(2), math.log(10)
_GRAMS, _TOKENS = 0, 1
_REQUEST = "shelf long, member long, kind int, keys binary, counts binary"
_MERGED = "shelf long, member long, keys binary, counts binary"
_MODEL = "shelf long, keys binary, answers binary"
_ANSWER = "shelf long, member long, keys binary, answers binary"
_NODES = "ctx long, node int, zeros long, ones long, weighted double"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is left out of training: the CRC-32 of its id's text leaves 2 when divided by 7."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Words, with A-Z lower-cased; the end that follows them is the empty token."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Bytes between words, and A-Z lower-cased is what bytes.lower makes of it.
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def words_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts as tokens() has them: their bytes one after the other, where each begins (and the last ends), and the first word of each text."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    points = np.frombuffer(b"\n".join([*encoded, b""]).lower(), np.uint8)
    inside = ~_BLANK[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[0::2], edges[1::2]
    starts = np.cumsum([0, *(len(x) + 1 for x in encoded)])
    return points[inside], np.concatenate([[0], np.cumsum(end - begin)]), np.searchsorted(begin, starts)


def runs(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of DEPTH context bytes and a byte for each byte of texts (see words_of), packed into integers, and where each text ends.

    A text is its words with blanks between and a line break at its end; its first bytes have zeros for context.
    """
    each = np.diff(first)
    lengths = offsets[first[1:]] - offsets[first[:-1]] + np.maximum(each, 1)
    ends = np.cumsum(lengths + DEPTH)  # the bytes of text i stand at ends[i] - lengths[i] to ends[i]
    begin = ends - lengths
    sizes = np.diff(offsets)
    place = np.repeat(begin - offsets[first[:-1]] - first[:-1], each) + np.arange(len(sizes))  # of a word, less its offset
    points = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    points[np.arange(len(data)) + np.repeat(place, sizes)] = data
    points[place + offsets[1:]] = 32
    points[ends - 1] = _END[0]
    n = max(0, len(points) - DEPTH)
    run = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        run <<= 8
        run |= points[k : k + n]
    keep = np.ones(len(points), bool)
    keep[(begin[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return run[keep[DEPTH:]], np.cumsum(lengths)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int64))


def _token_list(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Tokens as an Arrow array, of their bytes and where each begins."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _token_bytes(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens and where each begins."""
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pack_tokens(own: pa.Array) -> bytes:
    data, offsets = _token_bytes(own)
    joined = np.full(len(data) + len(own) - 1, 32, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(len(own)), np.diff(offsets))] = data
    return zstandard.ZstdCompressor(level=1).compress(joined.tobytes())


def _unpack_tokens(data: bytes) -> pa.Array:
    points = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    between = points == 32
    at = np.flatnonzero(between)
    return _token_list(points[~between], np.concatenate([[0], at - np.arange(len(at)), [len(points) - len(at)]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted lists and their summed counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _mixed(run: np.ndarray) -> np.ndarray:
    """A hash of a run's last ROOTED context bytes, whose digits to the base FAN are its shelves."""
    context = ((run >> 8) & ((1 << 8 * ROOTED) - 1)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).astype(np.int64)


class Runs:
    """Lists of runs: sorted integers."""

    pack, unpack, merge = staticmethod(_pack_sorted), staticmethod(_unpack_sorted), staticmethod(_merge)

    @staticmethod
    def digits(keys: np.ndarray, level: int) -> np.ndarray:
        return _mixed(keys) // FAN**level % FAN

    @staticmethod
    def take(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        return keys[at]

    @staticmethod
    def answer(keys: list[np.ndarray], answers: list[np.ndarray], asked: list[np.ndarray]) -> list[np.ndarray]:
        known, values = np.concatenate(keys), np.concatenate(answers)
        order = np.argsort(known)
        known, values = known[order], values[order]
        return [values[np.searchsorted(known, k)] for k in asked]


_HASH = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


class Tokens:
    """Lists of tokens: Arrow arrays of bytes."""

    pack, unpack = staticmethod(_pack_tokens), staticmethod(_unpack_tokens)

    @staticmethod
    def merge(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        if not parts:
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        found = pa.concat_arrays([k for k, _ in parts]).dictionary_encode()
        own, counts = found.dictionary, np.bincount(found.indices.to_numpy(), np.concatenate([c for _, c in parts]), len(found.dictionary)).astype(np.int64)
        # in the order of their first bytes, so that they pack well
        data, offsets = _token_bytes(own)
        sizes, padded, begin = np.diff(offsets), np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64), np.zeros(len(own), np.uint64)
        for k in range(8):
            begin = (begin << np.uint64(8)) | np.where(sizes > k, padded[offsets[:-1] + k], 0).astype(np.uint64)
        order = np.argsort(begin)
        return own.take(pa.array(order)), counts[order]

    @staticmethod
    def digits(keys: pa.Array, level: int) -> np.ndarray:
        data, offsets = _token_bytes(keys)
        with np.errstate(over="ignore"):
            place = (np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))) & 63
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _HASH[place], dtype=np.uint64)])
            h = (total[offsets[1:]] - total[offsets[:-1]]) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(24)).astype(np.int64) // FAN**level % FAN

    @staticmethod
    def take(keys: pa.Array, at: np.ndarray) -> pa.Array:
        return keys.take(pa.array(at))

    @staticmethod
    def answer(keys: list[pa.Array], answers: list[np.ndarray], asked: list[pa.Array]) -> list[np.ndarray]:
        at = pc.index_in(pa.concat_arrays(asked), value_set=pa.concat_arrays(keys)).to_numpy(zero_copy_only=False)
        return np.split(np.concatenate(answers)[at], np.cumsum([len(k) for k in asked])[:-1])


def _dealt(kind, keys, counts: np.ndarray, level: int, shelf: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(shelf, keys, counts) for each shelf of the level that has keys; the list is sorted by shelf once."""
    if not len(keys):
        return
    digits = kind.digits(keys, level)
    order = np.argsort(digits, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(digits[order])) + 1):
        yield shelf * FAN + int(digits[at[0]]), kind.pack(kind.take(keys, at)), _pack(counts[at])


def _requests(docs: pd.DataFrame) -> pd.DataFrame:
    """What a block asks for, dealt to the shelves of the first level."""
    block = int(docs["block"].iloc[0])
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    own: list[tuple[pa.Array, np.ndarray]] = []
    batch: dict[bool, list] = {True: [], False: []}
    size = 0

    def flush() -> None:
        for out, texts in batch.items():
            if texts:
                data, offsets, first = words_of(texts)
                found, n = np.unique(runs(data, offsets, first)[0], return_counts=True)
                grams.append((found, n * (not out)))
                words = _token_list(data, offsets).dictionary_encode()
                own.append((words.dictionary, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)) * (not out)))
                own.append((pa.array([b""], pa.large_binary()), np.array([len(texts) * (not out)])))
                texts.clear()

    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        batch[held_out(None if pd.isna(doc_id) else int(doc_id))].append(text)
        size += len(text or "")
        if size > 1 << 21:
            flush()
            size = 0
    flush()
    needed, counts = _merge(grams)
    words, known = Tokens.merge(own)
    rows = [(shelf, block, _GRAMS, keys, c) for shelf, keys, c in _dealt(Runs, needed, counts, 0, 0)]
    rows += [(shelf, block, _TOKENS, keys, c) for shelf, keys, c in _dealt(Tokens, words, known, 0, 0)]
    return pd.DataFrame(rows, columns=["shelf", "member", "kind", "keys", "counts"])


def levels_for(blocks: int) -> int:
    """Levels of the tree: as many as bring the lists of so many blocks into groups of FAN."""
    levels = 1
    while FAN**levels < blocks:
        levels += 1
    return levels


def _teams(lists: DataFrame):
    return lists.withColumn("team", F.floor(F.col("member") / FAN)).groupBy("shelf", "team")


def go_up(asked: DataFrame, levels: int, kind) -> tuple[list[DataFrame], DataFrame]:
    """The lists (shelf, member, keys, counts) of each level, and one row (shelf, member, keys, counts) for each part."""

    def merged(rows: pd.DataFrame):
        return kind.merge([(kind.unpack(k), _unpack(c, np.int64)) for k, c in zip(rows["keys"], rows["counts"], strict=True)])

    def onward(level: int):
        def deal(rows: pd.DataFrame) -> pd.DataFrame:
            team = int(rows["team"].iloc[0])
            out = [(shelf, team, keys, counts) for shelf, keys, counts in _dealt(kind, *merged(rows), level, int(rows["shelf"].iloc[0]))]
            return pd.DataFrame(out, columns=["shelf", "member", "keys", "counts"])

        return deal

    lists = [asked]
    for level in range(1, levels):
        lists.append(cut(_teams(lists[-1]).applyInPandas(onward(level), _MERGED)))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(rows)
        return pd.DataFrame([(rows["shelf"].iloc[0], rows["team"].iloc[0], kind.pack(keys), _pack(counts))], columns=["shelf", "member", "keys", "counts"])

    return lists, cut(_teams(lists[-1]).applyInPandas(whole, _MERGED))


def go_down(lists: list[DataFrame], model: DataFrame, kind, dtype: type) -> DataFrame:
    """(shelf, member, keys, answers) for the lists of the first level: what the parts' model (shelf, keys, answers) says of them."""

    def answered(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"shelf": [], "member": [], "keys": [], "answers": []})
        found = kind.answer([kind.unpack(k) for k in told["keys"]], [_unpack(a, dtype) for a in told["answers"]], [kind.unpack(k) for k in asked["keys"]])
        return pd.DataFrame({"shelf": asked["shelf"], "member": asked["member"], "keys": asked["keys"], "answers": [_pack(a.astype(dtype)) for a in found]})

    told = model.withColumn("team", F.lit(0).cast("long"))
    for asked in lists[::-1]:
        answers = _teams(asked).cogroup(told.groupBy("shelf", "team")).applyInPandas(answered, _ANSWER)
        if asked is not lists[0]:
            answers = cut(answers)
        told = answers.select(F.floor(F.col("shelf") / FAN).alias("shelf"), F.col("member").alias("team"), "keys", "answers")
    return answers


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive x, by Stirling's series eight steps up."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    rising = np.ones_like(y)
    for k in range(8):
        rising = rising * (x + k)
    return series - np.log(rising)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: sorted keys (context and bit path), counts, weighted probability and that of the children together."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.keys, self.zeros, self.ones, self.children = keys, zeros, ones, children
        self.own = kt(zeros, ones)
        self.weighted = self.own if children is None else np.logaddexp(self.own, children) - _LN2

    def parent_keys(self, depth: int) -> np.ndarray:
        """Keys of the nodes one byte of context shallower; depth: of this level."""
        context = (self.keys >> 8) & ((1 << 8 * (depth - 1)) - 1)
        return (context << 8) | (self.keys & 255)

    def above(self, depth: int) -> Level:
        keys, place = np.unique(self.parent_keys(depth), return_inverse=True)
        add = lambda x: np.bincount(place, x, len(keys))
        return Level(keys, add(self.zeros), add(self.ones), add(self.weighted))

    def mixed(self, rest: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left to deeper nodes and the mixture so far, given both at the parents."""
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        if self.children is None:
            return np.zeros_like(rest), mean + rest * one
        ratio = np.exp(np.clip(self.own - self.children, -700, 700))
        share = ratio / (1 + ratio)
        return rest * (1 - share), mean + rest * share * one


def bit_nodes(run: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of a run's byte: the node it is decided at and the bit."""
    context, byte = run >> 8, run & 255
    return [((context << 8) | ((1 << k) | (byte >> (8 - k))), (byte >> (7 - k)) & 1) for k in range(8)]


def deep_levels(run: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth DEPTH up to ROOTED (in this order) of the runs of a part."""
    nodes = []
    for node, bit in bit_nodes(run):  # sorted, as the runs are; those of two bits are never the same
        at = np.flatnonzero(np.diff(node, prepend=-1))
        ones, total = (np.add.reduceat(x, at) if len(at) else x for x in (counts * bit, counts))
        nodes.append((node[at], total - ones, ones))
    keys, zeros, ones = (np.concatenate(x) for x in zip(*nodes, strict=True))
    order = np.argsort(keys)
    levels = [Level(keys[order], zeros[order].astype(np.float64), ones[order].astype(np.float64), None)]
    for depth in range(DEPTH, ROOTED, -1):
        levels.append(levels[-1].above(depth))
    return levels


def _rooted_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for keys, counts in zip(rows["keys"], rows["counts"], strict=True):
            top = deep_levels(_unpack_sorted(keys), _unpack(counts, np.int64))[-1]
            yield pd.DataFrame({"ctx": top.keys >> 8, "node": (top.keys & 255).astype(np.int32), "zeros": top.zeros.astype(np.int64), "ones": top.ones.astype(np.int64), "weighted": top.weighted})


def _shallow(nodes: DataFrame, digits: int) -> DataFrame:
    """(shelf, ctx, node, rest, mean) of the nodes of depth ROOTED: what depths up to theirs give, mixed from the root down."""

    @F.pandas_udf("double")
    def own(zeros: pd.Series, ones: pd.Series) -> pd.Series:
        return pd.Series(kt(zeros.to_numpy(np.float64), ones.to_numpy(np.float64)))

    def both(a, b):  # ln((exp a + exp b) / 2)
        high = F.greatest(a, b)
        return high + F.log(F.exp(a - high) + F.exp(b - high)) - _LN2

    levels = {ROOTED: nodes}
    for depth in range(ROOTED - 1, -1, -1):
        below = levels[depth + 1].withColumn("ctx", F.col("ctx").bitwiseAND(F.lit((1 << 8 * depth) - 1)))
        summed = below.groupBy("ctx", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        levels[depth] = cut(summed.withColumn("own", own("zeros", "ones")).withColumn("weighted", both(F.col("own"), F.col("children"))))
    above = None
    for depth in range(ROOTED):
        level = levels[depth]
        ratio = F.exp(F.least(F.greatest(F.col("own") - F.col("children"), F.lit(-700.0)), F.lit(700.0)))
        share, one = ratio / (1 + ratio), (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
        if above is None:
            level = level.withColumns({"up_rest": F.lit(1.0), "up_mean": F.lit(0.0)})
        else:
            level = level.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1))).join(above, ["up", "node"])
        above = cut(level.select(F.col("ctx").alias("up"), "node", (F.col("up_rest") * (1 - share)).alias("up_rest"), (F.col("up_mean") + F.col("up_rest") * share * one).alias("up_mean")))
    last = levels[ROOTED].select("ctx", "node", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (ROOTED - 1)) - 1)).alias("up")).join(above, ["up", "node"])

    @F.pandas_udf("long")
    def part(ctx: pd.Series) -> pd.Series:
        run = ctx.to_numpy(np.int64) << 8
        shelf = np.zeros(len(run), np.int64)
        for level in range(digits):
            shelf = shelf * FAN + Runs.digits(run, level)
        return pd.Series(shelf)

    return last.select(part("ctx").alias("shelf"), "ctx", "node", F.col("up_rest").alias("rest"), F.col("up_mean").alias("mean"))


def _run_model(merged: pd.DataFrame, shallow: pd.DataFrame) -> pd.DataFrame:
    """The runs of a part, and log10 of the probability of each run's byte; positive for those that training has once at most."""
    if not len(merged):
        return pd.DataFrame({"shelf": [], "keys": [], "answers": []})
    packed = merged["keys"].iloc[0]
    run, counts = _unpack_sorted(packed), _unpack(merged["counts"].iloc[0], np.int64)
    levels = deep_levels(run, counts)[::-1]
    keys = (shallow["ctx"].to_numpy(np.int64) << 8) | shallow["node"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, rest, mean = keys[order], shallow["rest"].to_numpy()[order], shallow["mean"].to_numpy()[order]
    for depth, level in enumerate(levels, ROOTED):
        place = np.searchsorted(keys, level.keys if depth == ROOTED else level.parent_keys(depth))
        rest, mean = level.mixed(rest[place], mean[place])
        keys = level.keys
    score = np.zeros(len(run))
    for node, bit in bit_nodes(run):
        one = mean[np.searchsorted(keys, node)]
        score += np.log10(np.where(bit == 1, one, 1 - one))
    return pd.DataFrame([(merged["shelf"].iloc[0], packed, _pack(np.where(counts > 1, score, -score)))], columns=["shelf", "keys", "answers"])


class Lookup:
    """Values by integer key: one probe of a table, then of a smaller one of the keys that another key kept out of it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, mix: int = 0x9E3779B97F4A7C15):
        self.bits, self.mix = np.uint64(64 - max(8, int(2 * len(keys)).bit_length())), np.uint64(mix)
        # key and value lie side by side, as the two halves of one number, so that a probe fetches both
        self.table = np.zeros(1 << (64 - int(self.bits)), np.complex128)
        slots, held = self.table.view(np.int64)[0::2], self.table.view(np.float64)[1::2]
        slots[:] = -1
        at = self._slot(keys)
        slots[at] = keys
        # the last writer of a slot wins; its value must be its own
        won = slots[at] == keys
        held[at[won]] = values[won]
        self.rest = None if won.all() else Lookup(keys[~won], values[~won], mix * 0xD6E8FEB86659FD93 % (1 << 64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self.mix) >> self.bits).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = self.table[self._slot(keys)]
        out = found.view(np.float64)[1::2].copy()
        miss = np.flatnonzero(found.view(np.int64)[0::2] != keys)
        if len(miss):
            out[miss] = self.rest(keys[miss])
        return out


_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "rare_share"]


def _score(train_tokens: int, vocabulary: int):
    spread = train_tokens + vocabulary + 1

    def of_block(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in _COLUMNS})
        grams, counts = answers[answers["kind"] == _GRAMS], answers[answers["kind"] == _TOKENS]
        lookup = Lookup(np.concatenate([_unpack_sorted(k) for k in grams["keys"]]), np.concatenate([_unpack(a, np.float64) for a in grams["answers"]]))
        own, times = pa.concat_arrays([_unpack_tokens(k) for k in counts["keys"]]), np.concatenate([_unpack(a, np.int64) for a in counts["answers"]])
        logs = np.log10((times + 1) / spread)
        end = pc.index_in(pa.array([b""], pa.large_binary()), value_set=own)[0].as_py()
        texts, ids, size, words, firsts, scored = [], [], 0, [], [], []

        def flush() -> None:
            if not texts:
                return
            data, offsets, first = words_of(texts)
            run, ends = runs(data, offsets, first)
            found = lookup(run)
            at = np.concatenate([[0], ends])
            score, rare = np.diff(np.concatenate([[0.0], np.cumsum(-np.abs(found))])[at]), np.diff(np.concatenate([[0], np.cumsum(found > 0)])[at])
            length = np.diff(at)
            words.append(_token_list(data, offsets).dictionary_encode())
            firsts.append(first)
            scored.append((score, -score * _LOG10 / _LN2 / length, rare / length))
            texts.clear()

        for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
            texts.append(text)
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            size += len(text or "")
            if size > 1 << 21:
                flush()
                size = 0
        flush()
        # the tokens of all texts are looked up at once, each that a batch has
        places = pc.index_in(pa.concat_arrays([w.dictionary for w in words]), value_set=own).to_numpy(zero_copy_only=False)
        bases, knowns, tokens_of = [], [], []
        for w, first, place in zip(words, firsts, np.split(places, np.cumsum([len(w.dictionary) for w in words])[:-1]), strict=True):
            n, at = np.diff(first), w.indices.to_numpy()
            base, known = np.full(len(n), logs[end]), np.full(len(n), int(times[end] > 0))
            if len(at):
                some = n > 0
                base[some] += np.add.reduceat(logs[place][at], first[:-1][some])
                known[some] += np.add.reduceat((times[place] > 0).astype(np.int64)[at], first[:-1][some])
            bases.append(base)
            knowns.append(known)
            tokens_of.append(n + 1)
        score, bits, rare = (np.concatenate(x) for x in zip(*scored, strict=True))
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": list(map(held_out, ids)), "n_tokens": np.concatenate(tokens_of), "n_known": np.concatenate(knowns), "train_tokens": train_tokens, "base_score": np.concatenate(bases), "score": score, "bits_per_byte": bits, "rare_share": rare})
        return out[_COLUMNS]

    return of_block


def blocks_of(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc_id, text) of each row, and the number of blocks: so many that each has about block_bytes of text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    # the text is hashed too, so that rows without doc_id are not one block
    return own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long").alias("block"), "doc_id", "text"), blocks


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, rare_share) of each row of docs (doc_id, text).

    Learns from the documents that are not held out, whole texts and all of them. rare_share is the share of a text's
    bytes that training has once at most after the DEPTH bytes before them: low where the text, or nearly the same,
    was learned from another document too. A null text is empty: its end is its one token. Repeated rows are learned
    and scored each. A row without doc_id is learned from. Without training documents all estimates are even.
    """
    dealt, blocks = blocks_of(docs, block_bytes)
    levels = levels_for(blocks)
    asked = cut(dealt.groupBy("block").applyInPandas(_requests, _REQUEST))
    run_lists, merged = go_up(asked.where(F.col("kind") == _GRAMS).drop("kind"), levels, Runs)
    token_lists, counts = go_up(asked.where(F.col("kind") == _TOKENS).drop("kind"), levels, Tokens)
    shallow = _shallow(cut(merged.mapInPandas(_rooted_nodes, _NODES)), levels)
    model = cut(merged.groupBy("shelf").cogroup(shallow.groupBy("shelf")).applyInPandas(_run_model, _MODEL))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_unpack(c, np.int64) for c in rows["counts"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in found], "v": [int((c > 0).sum()) for c in found]})

    n, v = (int(x or 0) for x in counts.mapInPandas(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    of_runs = go_down(run_lists, model, Runs, np.float64).withColumn("kind", F.lit(_GRAMS))
    of_tokens = go_down(token_lists, counts.select("shelf", "keys", F.col("counts").alias("answers")), Tokens, np.int64).withColumn("kind", F.lit(_TOKENS))
    replies = of_runs.unionByName(of_tokens).withColumnRenamed("member", "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, rare_share double"
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_score(n, v), schema)


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts are their end alone; repeated rows are learned and scored each; no
    rows, no result.
    """
    return score(read_table(spark, sf_dir, "documents"))
