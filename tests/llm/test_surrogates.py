"""Personal data: forms of names, texts that are one long word, marks of our own, and a model in Python."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from quartzline.llm import surrogates

NAMES = [
    "Mr McDonald", "Mrs O'Brien", "Mr J. Smith", "Mr SMITH", "Sra. de la Cruz", "Mr Smith-Jones", "Mr John Paul Smith", "Frau Müller-Lüdenscheidt", "Herr von der Leyen",
    "Dr J. R. R. Tolkien", "Prof. D’Arcy", "Госпожа Иванова", "Κύριος Παπαδόπουλος", "Ms Anna de Vries", "Mr X", "Mrs Smith",
]


def replaced(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.text, r.n) for r in surrogates.replace_entities(rows, key, count="n").collect()}


def test_names_are_replaced_whole(spark):
    got = replaced(spark, [f"we met {n}, then left." for n in NAMES])
    shape = lambda s: re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0].islower() else ("A" if len(m[0]) == 1 else "AA" if m[0].isupper() else "Aa"), s)
    seen = set()
    for i, name in enumerate(NAMES):
        text, n = got[i]
        found = re.fullmatch(r"we met (.*), then left\.", text)[1]
        title, rest = name.split(" ", 1)
        assert n == 1 and found.startswith(title + " ") and found != name, name
        words = set(re.findall(r"[^\W\d_]{2,}", rest)) - set("de la von der".split())
        assert not words & set(re.findall(r"\w+", found))
        want = shape(rest)
        assert shape(found.split(" ", 1)[1]) == (want if name != "Mr X" else "Aa"), (name, found)
        seen.add(found)
    assert len(seen) == len(NAMES)


@pytest.mark.parametrize("text", ["x@" + "a." * 3000 + "com", "x@" + "a." * 500_000 + "com", "a" * 10**6, "1" * 10**6, "a." * 500_000, "a..-" * 250_000, "A" * 10**6, "x@a.b" * 200_000, "Mr A." * 200_000, "+1 " * 300_000, "@" * 10**6, "1-" * 500_000, "Mr " + "A" * 10**6, "Mr " + "A-" * 500_000], ids=lambda t: t[:8] + str(len(t)))
def test_long_texts_take_little_time(spark, text):
    marked = spark.range(1).select(F.size(F.split(surrogates._marked(F.concat(F.lit(text[: len(text) // 2]), F.lit(text[len(text) // 2 :]), F.col("id").cast("string"))), surrogates.OPEN)))
    marked.collect()
    start = time.perf_counter()
    marked.collect()
    assert time.perf_counter() - start < 5


def test_addresses(spark):
    whole = ["x@mail.example.com", "a.b-c_d%e+f@x.org", "é.ü@bücher.example", "x@1.2.com", "..odd@x.org", "x@mail.example.c0m", "x@a.b.c.d.e.f.info"]
    none = ["npm@1.2.3", "@home.org", "x@", "x@y", "a @b.org", "...@x.org"]
    got = replaced(spark, [f"see {t}, now" for t in whole + none])
    for i, t in enumerate(whole):
        text, n = got[i]
        assert n == 1 and t.strip(".") not in text and text.startswith("see ") and text.endswith(", now"), (t, text)
    for i, t in enumerate(none, len(whole)):
        assert got[i] == (f"see {t}, now", 0)
    assert replaced(spark, ["see ..odd@x.org and odd@x.org."])[0][0].split(" and ")[0][6:] == replaced(spark, ["see ..odd@x.org and odd@x.org."])[0][0].split(" and ")[1][:-1]


def test_marks_of_our_own_stay(spark):
    own = "a"
    got = replaced(spark, [own, own + " to x@y.org " + own, f"{own}x@y.org{own}", None, ""])
    assert got[0] == (own, 0) and got[3] == (None, 0) and got[4] == ("", 0)
    assert got[1][1] == 1 and got[1][0].startswith(own + " to ") and got[1][0].endswith(" " + own) and "x@y" not in got[1][0]
    assert got[2][1] == 1 and got[2][0].startswith(own) and got[2][0].endswith(own)


def test_key_decides(spark):
    texts = ["ask Mr Smith or x@y.org"]
    assert replaced(spark, texts) == replaced(spark, texts) != replaced(spark, texts, "other")
    with pytest.raises(TypeError):
        surrogates.replace_entities(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_documents_against_a_model(spark):
    """Of the table's own kinds: each is replaced, one by one, distinct and the same everywhere; all else stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    mail = re.compile(r"[\w.]+@mail\d+\.example\.com")
    after = {r.doc_id: r.text for r in surrogates.replace_entities(docs, "k").collect()}
    assert before.keys() == after.keys()
    pairs = {}
    for d, text in before.items():
        new = after[d]
        old_mails, new_mails = mail.findall(text), re.findall(r"[\w.]+@\w+\.\w+\.com", new)
        assert len(old_mails) == len(new_mails)
        for a, b in zip(old_mails, new_mails, strict=True):
            assert pairs.setdefault(a, b) == b
        if "@" not in text and not re.search(r"\d", text) and not re.search(r"\b(Mr|Mrs|Dr)\b", text):
            assert new == text
    assert pairs and len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
