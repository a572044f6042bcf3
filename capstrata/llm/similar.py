"""Exact similarity join: all texts whose word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set of shingles are one class. By the prefix principle, two sets of that similarity have a shingle
in common among the first n - ceil(0.8 n) + 1 of each, whatever the order is, as long as it is one for all. Here
shingles that are frequent in a sample of the texts come last, and hashes order the rest. So a passage that many texts
share brings none of them together by itself.

SimHash and pigeonring come first: each class has a fingerprint of its shingles, and those of one fingerprint, and of
fingerprints that pigeonring finds within two bits, are compared by their whole sets. No number of bits of 64 tells
the similarity of 0.8 from less, so what pigeonring leaves apart is searched by prefixes, exactly.

Classes with a shingle of their prefixes in common are a block. With the first pairs, each class is compared
with the one that stands for most of its blocks, then in large blocks those outside the largest group with some others of it;
what is connected then needs no further pairs. Of the rest those pairs of a block are met that may link two groups (in large blocks each class outside the largest group with every class of
another). A pair is met once for each run of shingles that follow each other in both prefixes, not for each shingle;
where a shingle stands in the two sets bounds what they may have in common, and parity sketches bound by how much they
differ: short ones inside the join, then ones that grow with the set. None of these bounds loses a link, and what they
leave is compared by whole sets. The components are exact, and large groups of near copies do not grow with the square
of their size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capstrata.llm import pigeonring
from capstrata.llm.common import connected_components, cut, in_parts, landed, new_folder, release

SEED, WORDS = 42, 5
#: A shingle of more classes is frequent, and a block of more classes is large.
BLOCK_LIMIT = 32
#: One text of so many, by its hash, is counted to learn which shingles are frequent. Any order of shingles gives the same links.
SAMPLE = 8
#: The most shingles that are set back (8 MB that every task has); beyond, only the most frequent are.
MOST_FREQUENT = 1 << 20
#: Classes that a task remembers to have sent.
_KNOWN = 1 << 20
#: Classes of the largest group of a large block that those outside it are compared with before all pairs are met, twice as many for each class.
HEADS = 4
#: Words of a short parity sketch, and shingles to one word of a wide one.
SKETCH, SHINGLES_A_WORD = 8, 32
#: Bits for each wanted class in the map that keeps most others from being sent, and the most bits (32 MB).
_BITS_EACH, _MOST_BITS = 16, 1 << 28
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
_CHUNK = 1 << 18
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _powers(n: int, odd: int, made: dict = {}) -> np.ndarray:  # noqa: B006  kept from call to call
    """odd**0 to odd**n modulo 2**64."""
    if odd not in made or len(made[odd]) <= n:
        with np.errstate(over="ignore"):
            each = np.full(max(n, _CHUNK) + 1, odd, np.uint64)
            each[0] = 1
            made[odd] = np.cumprod(each)
    return made[odd]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX_A
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, A-Z lower-cased, and where each begins.

    A word's bytes are the digits of a number to an odd base, taken from running sums over the text.
    """
    points = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * _powers(len(points), _BASE)[: len(points)], out=total[1:])
        hashes = (total[end] - total[begin]) * _powers(len(points), _BASE_INVERSE)[begin]
        return _mixed(hashes ^ ((end - begin).astype(np.uint64) * _MIX_B)), begin


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, sorted.

    A text with fewer words is one shingle, one without words has none.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        stop, size = at, 0
        while stop < len(encoded) and (stop == at or size + len(encoded[stop]) < _CHUNK):
            size += len(encoded[stop]) + 1
            stop += 1
        each, begin = _word_hashes(b"\n".join(encoded[at:stop]))
        starts = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in encoded[at:stop])]))
        with np.errstate(over="ignore"):
            runs = np.full(max(0, len(each) - words + 1), words, np.uint64)
            for i in range(words):
                runs = _mixed((runs ^ each[i : i + len(runs)]) * _MIX_B)
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if last - first >= words:
                    found = np.sort(runs[first : last - words + 1])
                    new = np.empty(len(found), bool)
                    new[0] = True
                    np.not_equal(found[1:], found[:-1], out=new[1:])
                    yield found if new.all() else found[new]
                elif last > first:
                    short = np.uint64(last - first)
                    for h in each[first:last]:
                        short = _mixed((short ^ h) * _MIX_B)
                    yield np.array([short], np.uint64)
                else:
                    yield np.zeros(0, np.uint64)
        at = stop


def class_of(hashes: np.ndarray) -> int:
    """The class of a set of shingles, as a signed long."""
    h = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _alike(shared: Column) -> Column:
    """Whether sets of n and other_n shingles with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (F.col("n") + F.col("other_n"))


def parity_sketch(hashes: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Words of 64 bits, of which each says whether an odd number of a set's hashes falls to it.

    Sketches of two sets differ in at most as many bits as the sets do in elements. One of half as many words is this
    one's halves laid over each other.
    """
    places = (hashes >> np.uint64(20)) & np.uint64(64 * words - 1)
    odd = np.bincount(places.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide sketch of a set of n shingles: a power of two, so that sets of nearly one size have one size or twice that."""
    return max(SKETCH, 1 << (n // SHINGLES_A_WORD).bit_length())


def _each_class(texts: pa.Array, known: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of each text with words, a class once for what a task remembers."""
    for found in shingle_sets(texts.to_pylist()):
        fp = class_of(found)
        if len(found) and fp not in known:
            if len(known) >= _KNOWN:
                known.clear()
            known.add(fp)
            yield fp, found


def _ordered(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the order of all, and how many of it are not frequent."""
    if not len(frequent):
        return found, len(found)
    late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
    return np.concatenate([found[~late], found[late]]), int(len(found) - late.sum())


def _frequent(docs: DataFrame, block_limit: int, sample: int) -> np.ndarray:
    """Shingles of so many classes of a sample that all have more than block_limit, sorted; the most frequent of them where there are more than MOST_FREQUENT.

    One text of `sample` is counted, by its hash; shingles are added up before the shuffle.
    """
    least = max(1, block_limit // sample)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in in_parts(it):
            if tokens := [found for _, found in _each_class(batch.column(0), known)]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64))], names=["token"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counted = cut(some.mapInArrow(batches, "token long").groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > least))
    room = MOST_FREQUENT
    for r in counted.groupBy(F.floor(F.log2("k")).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # 64 rows at most
        room -= r.n
        if room < 0:
            least = max(least, 1 << r.size + 1)
            break
    return np.sort(counted.where(F.col("k") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _prints(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The columns of docs but for text, and of each row fp: its class, n: the size of its set; sketch and wide: its sketches,
    simhash: its fingerprint, prefix: the prefix in the order of all, early: how many of it are not frequent. These last are null where the task
    has given them for the same class before. Written once, in the shared folder.
    """
    others = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in in_parts(it):
            rows = []
            for found in shingle_sets(batch.column("text").to_pylist()):
                fp = class_of(found)
                if fp in known:
                    rows.append((fp, len(found), None, None, None, None, None))
                    continue
                if len(known) >= _KNOWN:
                    known.clear()
                known.add(fp)
                ordered, early = _ordered(found, shared.value)
                first = _prefix_length(len(found))
                simhash = np.uint64(pigeonring.majority(found)).astype(np.int64)
                rows.append((fp, len(found), simhash, parity_sketch(found), parity_sketch(found, wide_words(len(found))), ordered[:first].view(np.int64), min(first, early)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PRINT)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(list(c), kind) for c, kind in zip(columns, _PRINT.values(), strict=True))], names=[*others, *_PRINT])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    path = new_folder(docs.sparkSession, "prints")
    docs.mapInArrow(batches, schema + ", fp long, n int, simhash long, sketch array<long>, wide array<long>, prefix array<long>, early int").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


_PRINT = {"fp": pa.int64(), "n": pa.int32(), "simhash": pa.int64(), "sketch": pa.list_(pa.int64()), "wide": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64()), "early": pa.int32()}


def _members(prints: DataFrame) -> DataFrame:
    """(token, fp, n, late, k, pos, before, prev) of the prefixes of all classes, for tokens in several classes.

    late: whether the token is frequent; k: the size of its block; pos: its place in the set; before: how many tokens
    that are in several classes come before it, prev: the last of those. Blocks of rare tokens are gathered as groups,
    those of frequent ones only joined.
    """
    rows = prints.where("prefix is not null").select("fp", "n", "early", F.posexplode("prefix").alias("pos", "token"))
    late = (F.col("pos") >= F.col("early")).alias("late")
    # rows of rare tokens meet by token, those of frequent ones are dealt out by class
    dealt = rows.select("token", F.when(late, F.col("fp")).otherwise(F.lit(0)).alias("salt"), "fp", "n", late, "pos").repartition("token", "salt").distinct()
    found = cut(dealt.withColumn("k", F.count("*").over(Window.partitionBy("token", "salt"))).where("late or k > 1").drop("salt"))
    often = found.where("late").drop("k")
    sizes = cut(often.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    several = found.where("not late").unionByName(often.join(sizes, "token").select(found.columns))
    order = Window.partitionBy("fp").orderBy("pos")
    return cut(several.withColumns({"before": F.row_number().over(order) - 1, "prev": F.lag("token").over(order)}))


def _bitmap(bits: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of all rows of a task as one bitmap."""
        out = np.zeros(bits // 8, np.uint8)
        for batch in it:
            places = batch.column(0).to_numpy()
            np.bitwise_or.at(out, places >> 3, (1 << (places & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    return batches


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, hashes) of the wanted classes. A bitmap of bounded size keeps most of the others from being sent."""
    size = wanted.count()
    bits = min(_MOST_BITS, max(1 << 12, 1 << (_BITS_EACH * size).bit_length()))
    # four maps at most, of bounded size, meet in the driver; no further workers are started for that
    maps = wanted.select(F.expr(f"fp & {bits - 1}").alias("place")).coalesce(4).mapInArrow(_bitmap(bits), "bits binary").toArrow().column(0)
    shared = docs.sparkSession.sparkContext.broadcast(functools.reduce(np.bitwise_or, (np.frombuffer(m.as_buffer(), np.uint8) for m in maps), np.zeros(bits // 8, np.uint8)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        asked = shared.value
        for batch in in_parts(it):
            sets = {fp: found.view(np.int64) for fp, found in _each_class(batch.column(0), known) if asked[(fp & bits - 1) >> 3] >> (fp & 7) & 1}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], names=["fp", "hashes"])

    found = docs.select("text").mapInArrow(batches, "fp long, hashes array<long>")
    return cut(found.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))


def _near_by(differ: Column) -> Column:
    """Whether sets whose sketches differ in so many bits may be alike: those differ in at most (n + other_n) / 9 elements."""
    return 9 * differ <= F.col("n") + F.col("other_n")


def _sketches_near() -> Column:
    return _near_by(functools.reduce(Column.__add__, (F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("other_sketch", F.lit(i)))) for i in range(SKETCH))))


def _wide_near() -> Column:
    """The same of the wide sketches, of which the larger is folded to the size of the other."""

    def folded(one: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(one) > half, F.zip_with(F.slice(one, 1, half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(one)

    one, other = F.col("wide"), F.col("other_wide")
    differing = F.zip_with(folded(one, other), folded(other, one), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _near_by(F.aggregate(differing, F.lit(0), lambda total, x: total + x))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst) of the distinct pairs (fp, other) that are alike by their whole sets."""
    near = pairs.join(classes, "fp").join(classes.select(*(F.col(c).alias("other" if c == "fp" else f"other_{c}") for c in classes.columns)), "other")
    pairs = cut(near.where(_lengths() & _sketches_near()).where(_wide_near()).select("fp", "other"))
    if pairs.isEmpty():
        return pairs.select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    sets = _sets(docs, cut(pairs.select("fp").unionByName(pairs.select(F.col("other").alias("fp"))).distinct()))
    left = pairs.join(sets.select("fp", F.col("hashes").alias("mine")), "fp")
    both = left.join(sets.select(F.col("fp").alias("other"), F.col("hashes").alias("theirs")), "other")
    sized = both.withColumns({"n": F.size("mine"), "other_n": F.size("theirs")})
    return landed(sized.where(_alike(F.size(F.array_intersect("mine", "theirs")))).select(F.col("fp").alias("src"), F.col("other").alias("dst")))


_MEMBER = ("fp", "n", "pos", "before", "prev")


def _other(block: DataFrame) -> DataFrame:
    return block.select("token", *(F.col(c).alias("other" if c == "fp" else f"other_{c}") for c in (*_MEMBER, "root", "sketch") if c in block.columns))


def _lengths() -> Column:
    return 5 * F.least("n", "other_n") >= 4 * F.greatest("n", "other_n")


def _pair_sizes() -> list[Column]:
    return [(F.col("n") + F.col("other_n")).alias("both"), F.greatest("n", "other_n").alias("longer")]


def _reachable() -> Column:
    """Whether a pair that shares c shingles of its prefixes may be alike.

    A shared shingle lies in both prefixes, or beyond the prefix that ends first in the order of all.
    """
    most_shared = F.col("c") + F.floor((4 * F.col("longer") + 4) / 5) - 1
    return 9 * most_shared >= 4 * F.col("both")


def _by_place() -> Column:
    """Whether sets that have a token in common may be alike, by where it stands in them.

    What they share before it is among the tokens there that several classes have, what they share after it among all there.
    """
    most = F.least("before", "other_before") + 1 + F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos")) - 1
    return _alike(most)


def _first_of_run() -> Column:
    """Whether the tokens before are not one and the same, in whose block the pair was met."""
    return F.col("prev").isNull() | F.col("other_prev").isNull() | (F.col("prev") != F.col("other_prev"))


def ring_pairs(prints: DataFrame, firsts: DataFrame) -> DataFrame:
    """(fp, other) of classes by their fingerprints: each with the first of the same one, and the first of each with that of one within two bits.

    prints: fp, simhash; firsts: simhash, first: the first class of each. Fingerprints within two bits are found by pigeonring.
    """
    same = prints.join(firsts, "simhash").where("fp <> first").select("fp", F.col("first").alias("other"))
    near = pigeonring.links(firsts.select(F.col("simhash").alias("fp"))).groupBy(F.col("dst").alias("simhash")).agg(F.min("src").alias("src"))
    around = near.join(firsts.select(F.col("simhash").alias("src"), F.col("first").alias("other")), "src").join(firsts, "simhash")
    return cut(same.unionByName(around.select(F.col("first").alias("fp"), "other")))


def _stars(members: DataFrame) -> DataFrame:
    """(fp, other): each class with the one that stands for most of its blocks, lengths allowing.

    The one that stands for a block is the first by a hash, so that the blocks of one group mostly have the same.
    """
    first = F.min(F.struct(F.xxhash64("fp").alias("order"), F.col("fp").alias("other"), F.col("n").alias("other_n"))).alias("first")
    heads = cut(members.groupBy("token").agg(first).select("token", "first.other", "first.other_n"))
    pairs = members.join(heads, "token").where(F.col("fp") != F.col("other")).where(_lengths())
    counted = pairs.groupBy("fp", "other", *_pair_sizes()).agg(F.count("*").alias("c")).where(_reachable())
    return counted.groupBy("fp").agg(F.max_by("other", F.struct("c", "other")).alias("other"))


def _open_blocks(members: DataFrame, classes: DataFrame, roots: DataFrame, large: bool) -> DataFrame:
    """members of the blocks of several groups, with root: the group of the class, sketch, and most: the largest group of the block."""
    tagged = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "sketch")
    grouped = cut(members.where("late" if large else "not late").select("token", *_MEMBER).join(tagged, "fp"))
    shares = grouped.groupBy("token", "root").agg(F.count("*").alias("m"))
    most = cut(shares.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1"))
    return grouped.join(most, "token")


def _may_be_alike() -> Column:
    return _lengths() & _by_place() & _sketches_near()


def _more_heads(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, other), distinct: each class outside the largest group of a large block with some of that group, others in each block.

    So few of the classes that belong to a large group stay outside it, whichever of its members they are like.
    """
    open_ = cut(_open_blocks(members, classes, roots, True))
    few = Window.partitionBy("token").orderBy(F.xxhash64("token", "fp"), "fp")
    heads = open_.where("root = most").withColumn("at", F.row_number().over(few)).where(F.col("at") <= HEADS)
    pairs = open_.where("root <> most").join(_other(heads), "token").where(_may_be_alike()).select("fp", "other").distinct()
    chosen = Window.partitionBy("fp").orderBy(F.xxhash64("fp", "other"), "other")
    some = cut(pairs).withColumn("at", F.row_number().over(chosen)).where(F.col("at") <= 2 * HEADS)
    return cut(some.select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other")).distinct())


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that links (src, dst) make of those of roots, each of which is one node of theirs."""
    for end in ("src", "dst"):
        links = links.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    above = cut(connected_components(links))
    lifted = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return landed(lifted.unionByName(above.join(roots.select("node"), "node", "left_anti")))


def _open_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, other), distinct, of classes of two groups that may be alike by their places and short sketches.

    The pairs of small and of large blocks are written one after the other: the driver holds one short plan at a time.
    """
    found = []
    for large in (False, True):
        open_ = _open_blocks(members, classes, roots, large)
        if large:  # a class of the largest group meets only the others, from their side
            pairs = open_.where("root <> most").join(_other(open_), "token")
            apart = (F.col("root") != F.col("other_root")) & ((F.col("other_root") == F.col("most")) | (F.col("fp") < F.col("other")))
        else:
            pairs = open_.join(_other(open_), "token")
            apart = (F.col("root") != F.col("other_root")) & (F.col("fp") < F.col("other"))
        found.append(cut(pairs.where(apart & _first_of_run() & _may_be_alike()).select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other")).distinct()))
    return cut(found[0].unionByName(found[1]).distinct())


def _linked(docs: DataFrame, block_limit: int, sample: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with fp, links of the comparisons by fingerprints and with heads, components (node, root) of those, links that join them further)."""
    prints = _prints(docs, _frequent(docs, block_limit, sample))
    known = cut(prints.where("sketch is not null").select("fp", "n", "simhash", "sketch", "wide").dropDuplicates(["fp"]))
    classes, fingerprints = known.drop("simhash"), known.select("fp", "simhash")
    firsts = cut(fingerprints.groupBy("simhash").agg(F.min("fp").alias("first")))
    members = _members(prints)
    release(docs.sparkSession)
    pairs = cut(ring_pairs(fingerprints, firsts).unionByName(_stars(members)).distinct())
    release(docs.sparkSession)
    first = _verified(pairs, docs, classes)
    release(docs.sparkSession)
    roots = landed(connected_components(first))
    release(docs.sparkSession)
    second = _verified(_more_heads(members, classes, roots), docs, classes)
    release(docs.sparkSession)
    roots = _joined(roots, second)
    release(docs.sparkSession)
    further = _verified(_open_pairs(members, classes, roots), docs, classes)
    release(docs.sparkSession)
    return prints.drop(*(c for c in _PRINT if c != "fp")), first.unionByName(second), roots, further


def similar(docs: DataFrame, block_limit: int = BLOCK_LIMIT, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """For docs (text string, and columns that are carried): those columns and fp of each row, and links (src, dst) of classes.

    The links join exactly those classes that pairs with a Jaccard similarity of 0.8 or more connect.
    """
    prints, links, _, further = _linked(docs, block_limit, sample)
    return prints, links.unionByName(further)


def grouped(docs: DataFrame, block_limit: int = BLOCK_LIMIT, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The same rows, and (node, root) of each class that has a link: root is the smallest class of its component.

    What the first comparisons have joined is one node in the search for the components of the rest.
    """
    prints, _, roots, further = _linked(docs, block_limit, sample)
    return prints, _joined(roots, further)
