"""Spelling variants: words that one inserted, deleted or replaced character turns into each other.

The words are a trie, and each node of it that branches has one heavy child: the one under which most words lie. Two
words part at one node, where at most one of them goes on to the heavy child; so the errors of a node are made by its
light children alone, which are merged into the heavy one. A word has no more light edges on its way than the logarithm
of the number of words, and for each of them it is written anew: with the next character skipped, with it replaced by
the heavy one, and with the heavy one put before it. Where such a terminal coincides with a word, the two are near.
Light children of one node merge with one another by what follows a character that any other may replace. Every near
pair comes about exactly once, so near words are counted without listing pairs.

On Spark the trie is never built: nodes are hashes of prefixes. Children are counted by partial sums, light edges found
by a join on nodes, coinciding terminals by a join on words. Two nodes of one hash only share their heavy character,
which any choice may be, as long as all words see the same one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import cut, in_parts, read_table

#: A word has so many characters at least, and is found so often at least.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A word's form is so many times as frequent at least.
RATIO = 10
#: Of so many (document, word) pairs one loses a character, by its hash, so that there are slips to find.
SLIPS = 31
_RUN = re.compile("[a-zÀ-ÿ]+")
#: What a task counts before it hands the counts on, and characters of words that are hashed at once.
_HELD_WORDS, _HELD_CHARS, _CHUNK = 1 << 17, 1 << 24, 1 << 18
_BASE, _STEP, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(doc_id: int | None, text: str | None, least_chars: int = LEAST_CHARS, slips: int | None = SLIPS) -> Counter[str]:
    """How often each word is found in a text: runs of letters, A-Z lower-cased, some of them with a slip."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for word, times in Counter(_RUN.findall(lowered)).items():
        if len(word) < least_chars:
            continue
        if slips:
            h = zlib.crc32(word.encode(), head)
            if h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least_chars:
                    continue
        found[word] += times
    return found


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """(word, n) over all rows of docs (doc_id, text; null: no words), of words long and frequent enough."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "k"])

        for batch in in_parts(it):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, times in words_of(doc, text, least_chars, slips).items():
                    if word not in held:
                        chars += len(word)
                    held[word] += times
                if len(held) >= _HELD_WORDS or chars >= _HELD_CHARS:
                    yield counted()
                    held, chars = Counter(), 0
        if held:
            yield counted()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "word string, k long")
    return found.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= least_count)


def trie_edges(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in words, depth, node, code point of the next character or 0 at the end) of every edge on every word's way."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers[np.arange(len(points)) - np.repeat(starts[:-1], lengths)], out=total[1:])
        place = np.repeat(np.arange(len(words)), lengths + 1)
        at = np.arange(len(place)) - place  # each word has one edge more than it has characters
        depth = at - starts[place]
        node = (total[at] - total[starts[place]]) ^ (depth.astype(np.uint64) * _STEP)
        node = (node ^ (node >> np.uint64(32))) * _MIX
    following = np.append(points, np.uint32(0))[at]
    following[depth == lengths[place]] = 0
    return place, depth, (node ^ (node >> np.uint64(29))).view(np.int64), following


def _edges(words: DataFrame) -> DataFrame:
    """(node, c, id, depth) of all words (id, word)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it, 10_000):
            ids, each = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(each):
                stop, size = at + 1, len(each[at])
                while stop < len(each) and size + len(each[stop]) <= _CHUNK:
                    size += len(each[stop])
                    stop += 1
                place, depth, node, following = trie_edges(each[at:stop])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(following.astype(np.int32)), pa.array(ids[at:stop][place]), pa.array(depth.astype(np.int32))], names=["node", "c", "id", "depth"])
                at = stop

    return words.select("id", "word").mapInArrow(batches, "node long, c int, id long, depth int")


def _light(words: DataFrame) -> DataFrame:
    """(word, n, depth, heavy) of every light edge; heavy: the character of the heavy child, null where words end there."""
    edges = _edges(words)
    children = edges.groupBy("node", "c").agg(F.count("*").alias("k"))
    # behind a checkpoint, so that both sides of the join are plain exchanges and the rows of a hot node can be split
    heavy = cut(children.groupBy("node").agg(F.max_by("c", F.struct("k", "c")).alias("h"), F.count("*").alias("children")).where("children > 1").select("node", "h"))
    light = edges.join(heavy, "node").where("c <> h").select("id", "depth", "h")
    return light.join(words, "id").select("word", "n", "depth", F.when(F.col("h") > 0, F.char("h")).alias("heavy"))


def _nearest(near: DataFrame) -> DataFrame:
    """(word, n_near, best) from rows (word, k, best), best being the first of (-n, word)."""
    return near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n; distinct) that have a near one: how many, and the most frequent, then first, of them.

    Words are of characters up to U+00FF. Each near pair is found once, by the one of its two that leaves the heavy path.
    """
    known = cut(words.select("word", "n", F.monotonically_increasing_id().alias("id")))
    light = cut(_light(known))
    before, rest, following = F.expr("substring(word, 1, depth)"), F.expr("substring(word, depth + 2)"), F.expr("substring(word, depth + 1)")
    inside = F.col("depth") < F.length("word")
    skipped = F.when(inside & (F.substring(rest, 1, 1) != F.substring(following, 1, 1)), F.concat(before, rest))
    replaced = F.when(inside, F.concat(before, "heavy", rest))
    inserted = F.concat(before, "heavy", following)
    written = light.select("word", "n", F.explode(F.array(skipped, replaced, inserted)).alias("target")).where("target is not null")
    met = written.join(known.select(F.col("word").alias("target"), F.col("n").alias("target_n")), "target")
    both = F.array(F.struct(F.col("word"), F.struct((-F.col("target_n")).alias("n"), F.col("target").alias("word")).alias("best")), F.struct(F.col("target").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word")).alias("best")))
    by_heavy = met.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("k"), "x.best")
    # light children of one node: at most as many as there are characters differ in this one
    one = F.struct((-F.col("n")).alias("n"), F.col("word"))
    groups = light.where(inside).groupBy(F.concat(before, F.lit("\x00"), rest).alias("key")).agg(F.array_sort(F.collect_list(one)).alias("all")).where(F.size("all") > 1)
    member = groups.select("all", F.explode("all").alias("own"))
    by_light = member.select("own.word", (F.size("all") - 1).cast("long").alias("k"), F.when(F.get("all", F.lit(0)) == F.col("own"), F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("best"))
    return _nearest(by_heavy.unionByName(by_light)).select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def followed(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): the last of a word's chain of forms (word, form), whose links are at most 2**rounds."""
    found = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        found = cut(found.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")))
    return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words (word, n; distinct).

    A word's form is its most frequent near word, then the first in code-point order, if it is `ratio` times as frequent
    at least; its root is the end of the chain of forms, itself without one. Frequencies along a chain grow by the
    ratio, which bounds its length. No words: no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent, so that chains of them end")
    words = cut(words)
    found = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    forms = found.where("form is not null")
    most, links = forms.agg(F.max("form_n")).first()[0] or 0, 0
    while most >= ratio:
        most, links = most // ratio, links + 1
    roots = followed(forms, links.bit_length())
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents. Null and empty texts have no words; repeated rows count each; a row
    without doc_id takes its slips as one without digits; no rows: none.
    """
    return variants(word_counts(read_table(spark, sf_dir, "documents")))


#: CRC-32 by its table of 256 entries, byte by byte; near words by what they are without one character or with a gap in its place.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY ALL HAVING length(word) >= 7
), coded AS (
    SELECT word, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word)) AS hexed FROM runs
), hashed AS (
    SELECT word, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(hexed, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(hexed) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM coded, crc
), slipped AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, k FROM hashed
), words AS (
    SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), gaps AS (
    SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.head || g.tail
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.head || g.tail
), nearest AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN nearest USING (word)
), chain AS (
    SELECT word, word AS root FROM formed UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.root WHERE form IS NOT NULL
), roots AS (
    SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN roots USING (word)
"""
