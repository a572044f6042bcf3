"""Fill-in-middle: against a plain version by regular expression, and exact round trips."""

import hashlib
import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capstrata.llm import fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
LONG = "wörd  \n" * 400_000


def plain(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


HARD = [None, "", " ", "\n\t", "a", " a", "a ", "  a b  c ", "<P>", "x <M", "<", "S>", "<S", "ab <M> c", "é ü ﬁ \U0001f600", "\x00 \x0b\x0c", "x<P <S <M", LONG]


def test_hard_texts(spark):
    rows = [(i, HARD[i % len(HARD)]) for i in range(12 * len(HARD))] + [(None, "one two"), (3, "repeated row"), (3, "repeated row"), (-7, "a b c"), (2**62, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "h0", "form", "output")}).repartition(3)
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert {r.form for r in made} == set(fim.FORMS)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, set()).add(text or "")
    assert all(r.back in texts[r.doc_id] for r in made)
    assert fim.transform(docs.limit(0)).count() == 0


@given(st.lists(st.text(st.sampled_from(list(" \n\tab<PSM>é\U0001f600")), max_size=30), max_size=20))
def test_kernel(texts):
    import numpy as np

    draws = np.array([[int.from_bytes(hashlib.sha256(f"{i}.{k}".encode()).digest()[:4]) for k in range(4)] for i in range(len(texts))], np.int64).reshape(-1, 4)
    made = fim.rearranged(pa.array(["before", *texts], pa.string()).slice(1), draws)
    for i, text in enumerate(texts):
        assert made["n"][i].as_py() == len(TOKEN.findall(text))
        if made["form"][i].as_py() == "plain":
            assert made["output"][i].as_py() == text
        else:
            head, middle = made["output"][i].as_py().split("<M>")
            a, b = made["prefix_chars"][i].as_py(), made["middle_chars"][i].as_py()
            assert middle == text[a : a + b]
            assert head == (f"<P>{text[:a]}<S>{text[a + b :]}" if made["form"][i].as_py() == "psm" else f"<S>{text[a + b :]}<P>{text[:a]}")


def test_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 16)
    rows = [(i, "ab cd ef " * (i % 5)) for i in range(40)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [tuple(r) for r in made] == [plain(*r) for r in rows]
