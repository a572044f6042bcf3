"""Fill-in-middle: texts cut at two places and put in another order, for models that learn to fill a gap.

The cuts lie between tokens, a token being a word with the white space before it, or the white space at a text's end.
All texts of an Arrow batch are cut together, on its UTF-8 buffers: a lookup gives the class of each byte, a mask of
adjacent bytes the ends of tokens, running sums that begin anew with each document number them, and one searchsorted
selects the cuts of all rows. No text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of a hundred of those so many have the suffix first.
REARRANGED, SUFFIX_FIRST, SEED = 50, 80, 42
FORMS = ("plain", "psm", "spm")
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins in them; last comes the end."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return held, places - places[0]


def token_counts(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the tokens that end up to and with it, for each text those before it, and the number of its own."""
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[places[1:][places[1:] > places[:-1]] - 1] = True  # a text's last byte ends a token, whatever follows in the buffer
    counts = np.cumsum(ends, dtype=np.int64)
    before = np.concatenate([[0], counts])[places]
    return counts, before[:-1], np.diff(before)


def cut_places(counts: np.ndarray, before: np.ndarray, starts: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where the first so many tokens of each text end."""
    return np.where(units > 0, np.searchsorted(counts, before + units) + 1, starts)


def holds_marker(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the markers."""
    found = np.zeros(len(places) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        hit = np.ones(max(0, len(data) - len(mark) + 1), bool)
        for k, byte in enumerate(mark.encode()):
            hit &= data[k : k + len(hit)] == byte
        at = np.flatnonzero(hit)
        text = np.searchsorted(places, at, side="right") - 1
        found[text[at + len(mark) <= places[text + 1]]] = True
    return found


def rearranged(texts: pa.Array, draws: np.ndarray, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; draws: four numbers of each."""
    data, places = buffers(texts)
    starts, stops = places[:-1], places[1:]
    counts, before, n = token_counts(data, places)
    first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    low = cut_places(counts, before, starts, np.minimum(first, second))
    high = cut_places(counts, before, starts, np.maximum(first, second))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    plain = (stops == starts) | holds_marker(data, places) | (draws[:, 2] % 100 >= share)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < suffix_first, 2, 1))
    held, mark = data.tobytes(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    parts = []
    for kind, s, a, b, e in zip(form.tolist(), starts.tolist(), low.tolist(), high.tolist(), stops.tolist(), strict=True):
        if kind == 0:
            parts.append(held[s:e])
        elif kind == 1:
            parts += (mark[0], held[s:a], mark[1], held[b:e], mark[2], held[a:b])
        else:
            parts += (mark[1], held[b:e], mark[0], held[s:a], mark[2], held[a:b])
    grown = stops - starts + np.where(plain, 0, sum(map(len, mark)))
    out = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(grown)]).astype(np.int32)), pa.py_buffer(b"".join(parts)))
    return {
        "n": pa.array(n),
        "form": pa.array(FORMS, pa.string()).take(pa.array(form)),
        "prefix_chars": pa.array(chars[low] - chars[starts], mask=plain),
        "middle_chars": pa.array(chars[high] - chars[low], mask=plain),
        "output": out,
    }


def transform(docs: DataFrame, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text; other columns are ignored).

    A null text is empty and stays so; a text that holds a marker stays as it is. The draws of a row hang on its doc_id
    alone (null: no digits), so repeated rows come out alike and a task that runs again gives the same. No rows: none.
    """
    number = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            places = buffers(batch.column(1))[1]
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(places, places[at] + CHUNK, side="right")) - 1)
                part = batch.slice(at, stop - at)
                drawn = np.stack([c.to_numpy() for c in part.columns[2:]], axis=1)
                made = rearranged(part.column(1), drawn, share, suffix_first)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], names=["doc_id", *made])
                at = stop
            pa.default_memory_pool().release_unused()

    rows = docs.select(number.alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of; each marker stands in a rearranged one once."""

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rearranged, with hashes of what was made and of what is read back from that.

    Null and empty texts are plain; repeated rows come out alike, rows without doc_id as one without digits; no rows: none.
    """
    made = transform(read_table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH drawn AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
    FROM documents
), cut AS (
    SELECT doc_id, body, CASE WHEN body = '' THEN [] ELSE regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS tokens,
        [CAST('0x' || substr(hex, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h
    FROM drawn
), placed AS (
    SELECT doc_id, body, tokens, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT doc_id, body, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix
    FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""
