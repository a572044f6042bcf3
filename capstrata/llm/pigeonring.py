"""SimHash fingerprints of sets of hashes, and the pairs of them that differ in few bits, by pigeonring.

A fingerprint has 64 bits, cut into five segments on a ring. If two fingerprints differ in at most two bits, the
pigeonring principle gives a start from which every chain of l consecutive segments has at most floor(2 * l / 5)
differences: none in the first two segments, at most one in the first three and in the first four, two in all five.
The first two segments are therefore an equality key (25 or 26 bits), and the rest of the chain prunes candidates
before the full Hamming check.

Blocks of more than `block_limit` fingerprints are not paired. Their members take the exact way of shared neighbours:
two fingerprints differ in at most two bits if and only if some value is within one bit of both, so each member is
grouped by the 65 values within one bit of it. Such a group has at most 65 members. Both ways find every link.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import cut

MAX_BITS = 2
#: Bits of each segment on the ring, from the lowest.
SEGMENTS = (13, 13, 13, 13, 12)
BLOCK_LIMIT = 32
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of so many 64-bit hashes have set, as an unsigned number. No hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _ring_members(fps: DataFrame) -> DataFrame:
    """Five rows for each fingerprint: the ring's start, the fingerprint turned to it, and the masks of its chain."""
    starts, at = [], 0
    for i in range(len(SEGMENTS)):
        turned = F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", (64 - at) % 64)) if at else F.col("fp")
        widths = [SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(len(SEGMENTS))]
        two, four = sum(widths[:2]), sum(widths[:4])
        starts.append(F.struct(F.lit(i).alias("start"), turned.alias("turned"), turned.bitwiseAND(F.lit((1 << two) - 1)).alias("key"), F.lit((1 << four) - 1).alias("chain")))
        at += SEGMENTS[i]
    return fps.select("fp", F.explode(F.array(*starts)).alias("m")).select("fp", "m.*")


def links(fps: DataFrame, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(src, dst) of distinct fingerprints: enough true links (2 or fewer differing bits) to join all that are linked."""
    members = _ring_members(fps)
    sizes = cut(members.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(members.join(sizes, ["start", "key"]))
    a = members.where(F.col("n") <= block_limit)
    b = a.select("start", "key", F.col("fp").alias("other"), F.col("turned").alias("other_turned"))
    differ = F.col("turned").bitwiseXOR(F.col("other_turned"))
    # chain of three segments is part of the chain of four, whose budget is the same
    near = a.join(b, ["start", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(differ.bitwiseAND(F.col("chain"))) <= 1) & (F.bit_count(differ) <= MAX_BITS))
    near = near.select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    hot = members.where(F.col("n") > block_limit).select("fp").distinct()
    around = hot.select("fp", F.explode(F.array_union(F.array("fp"), flips)).alias("value"))
    shared = around.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = shared.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return near.unionByName(star).distinct()
