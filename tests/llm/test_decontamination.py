"""Benchmark decontamination against brute force."""

import hashlib
import re

import pytest
from conftest import TESTDATA

import oracle
from pulseplan.llm import decontamination as dc
from pulseplan.llm import registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return [w.translate(UPPER) for w in WORD.findall(text or "")]


def brute(docs, items, size=10):
    """(doc_id, n_words, hit word numbers, item ids) of each row."""
    windows = []
    for item, text in items:
        own = split(text)
        n = min(size, len(own))
        windows += [(tuple(own[i : i + n]), item) for i in range(len(own) - n + 1) if n]
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for window, item in windows:
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(own), frozenset(hit), tuple(sorted(found))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ALPHABET = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
ITEMS = [
    (1, " ".join(ALPHABET[:14])),
    (2, "Ñandú, ÉTÉ"),  # two words: one window, only A-Z in lower case
    (10, " ".join(ALPHABET[4:16])),
    (None, "no id here"),
    (3, ""),
    (4, None),
    (1, "twice the id"),
    (5, " ".join(ALPHABET[:14])),
]
TEXTS = [
    (1, "x " + " ".join(ALPHABET[:14]).upper() + " y"),
    (2, "ñandú ÉTÉ; Ñandú été. ÑANDÚ-ÉTÉ Ñandú|ÉTÉ"),
    (3, "nothing"),
    (4, ""),
    (5, None),
    (None, "see: no\nid, here!"),
    (6, "a,b.c d e f g h i j"),
    (6, "a,b.c d e f g h i j"),
    (6, "twice the id twice the id"),
    (7, "a b c d e f g h i"),
    (8, ("filler words " * 700) + " ".join(ALPHABET[2:15]) + " tail " * 600),
    (9, "  !!"),
]


@pytest.mark.parametrize("set_bytes", [dc.SET_BYTES, 300])
def test_against_brute_force(spark, set_bytes, monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 16)
    found = dc.contamination(frame(spark, TEXTS), bench(spark, ITEMS), set_bytes=set_bytes)
    got = sorted(((i, n, h, tuple(ids)) for i, n, h, ids in found.collect()), key=repr)
    assert got == sorted(((i, n, len(h), ids) for i, n, h, ids in brute(TEXTS, ITEMS)), key=repr)


def test_digests(spark):
    found = {r.doc_id: r for r in dc.digests(frame(spark, TEXTS), bench(spark, ITEMS)).collect()}
    assert found[1].items_sha256 == hashlib.sha256(b"1,10,5").hexdigest()
    assert found[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (found[None].contaminated, found[None].n_items) == (True, 0)  # an item without an id


@pytest.mark.parametrize("items", [[], [(1, ""), (2, None)]])
def test_nothing_to_find(spark, items):
    docs = frame(spark, TEXTS)
    assert all(r.n_hit == 0 for r in dc.contamination(docs, bench(spark, items)).collect())
    assert dc.decontaminate(docs, bench(spark, items)).count() == len(TEXTS)
    assert dc.digests(frame(spark, []), bench(spark, ITEMS)).count() == 0


def test_hot_passage_and_repeated_rows(spark):
    passage = " ".join(ALPHABET[:14])
    rows = [(i % 5, f"{passage} {passage}") for i in range(600)] + [(i, f"clean {i}") for i in range(900)]
    found = dc.contamination(frame(spark, rows), bench(spark, [(i, passage) for i in range(50)]))
    hot = [r for r in found.collect() if r.n_hit]
    assert len(hot) == 600
    assert {(r.n_words, r.n_hit, len(r.item_ids)) for r in hot} == {(28, 28, 50)}


CLASHING = "key1 string, key2 int, hit long, items string, doc string, left string, pieces int, start int, w int"


def test_documents_are_removed_and_columns_stay(spark):
    extra = ("k", 2, 3, "i", "d", "l", 4, 5, 6)
    rows = [(i, t, "en", "s", 7, *extra) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")
    left = dc.decontaminate(docs, bench(spark, ITEMS))
    assert left.schema == docs.schema
    clean = [r for r, b in zip(rows, brute(TEXTS, ITEMS), strict=True) if not b[2]]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(clean, key=repr)
    spans = dc.decontaminate(docs, bench(spark, ITEMS), remove="spans")
    assert spans.schema == docs.schema
    for row, (doc, _, hit, _) in zip(
        sorted(spans.collect(), key=lambda r: (str(r.doc_id), r.n_chars or 0, str(r.text))),
        sorted(brute(TEXTS, ITEMS), key=lambda b: str(b[0])), strict=True,
    ):
        assert str(row.doc_id) == str(doc)
    kept = sorted((repr(r.doc_id), " ".join(split(r.text))) for r in spans.collect())
    expected = sorted(
        (repr(d), " ".join(w for n, w in enumerate(split(t)) if n not in hit))
        for (d, t), (_, _, hit, _) in zip(TEXTS, brute(TEXTS, ITEMS), strict=True)
    )
    assert kept == expected
    assert all(r.n_chars in (7, len(r.text)) for r in spans.collect() if r.text is not None)


def test_unknown_removal(spark):
    with pytest.raises(ValueError, match="documents or spans"):
        dc.decontaminate(frame(spark, []), bench(spark, []), remove="lines")


def test_no_python_and_one_broadcast_pass(spark):
    """The texts are scanned against a broadcast set; they are in no exchange."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet"))
    items = spark.read.parquet(str(TESTDATA / "sf0.001" / "benchmark.parquet"))
    plan = dc.digests(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    for line in plan.splitlines():
        assert not ("Exchange hashpartitioning" in line and "text" in line)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    sf_dir = str(TESTDATA / sf)
    found = registry.op11_decontamination(spark, sf_dir)
    assert oracle.compare(found, oracle.connect(sf_dir), dc.CONTAMINATION_SQL) == []
