"""Line dedup against a comparison of every two lines."""

import re
import zlib

import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseplan.llm import line_dedup, registry

SCHEMA = "doc_id long, text string, n_chars int, key string, line string, n int, place string, ld_id int, ld_kept int, ld_doc int, ld_sum int, ld_crc int, doc string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    """For each row: its numbers of lines with words, and of those that stay."""
    seen, lines = set(), []
    for i, t in rows:
        t = t or ""
        key = (-(1 << 63) if i is None else i, zlib.crc32(t.encode()))
        if key not in seen:
            seen.add(key)
            lines += [(key, n, frozenset(WORD.findall(x))) for n, x in enumerate(t.split("\n")) if WORD.search(x)]
    lines.sort(key=lambda r: r[:2])
    kept, before = {}, {}
    for key, n, words in lines:
        if words in before:
            continue
        near = any(
            9 * len(words & o) >= 4 * (len(words) + len(o))
            for o in before
            if 5 * min(len(words), len(o)) >= 4 * max(len(words), len(o))
        )
        before[words] = True
        if not near:
            kept.setdefault(key, []).append(n)
    out = []
    for i, t in rows:
        key = (-(1 << 63) if i is None else i, zlib.crc32((t or "").encode()))
        out.append((i, sum(bool(WORD.search(x)) for x in (t or "").split("\n")), kept.get(key, [])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k", "l", 5, "p", 1, 2, 3, 4, 5, "d") for i, t in rows], SCHEMA)


def check(spark, rows):
    docs, want = frame(spark, rows), expected(rows)
    got = sorted(map(tuple, line_dedup.line_decisions(docs).collect()), key=repr)
    assert got == sorted(((i, n, len(k), ",".join(map(str, k))) for i, n, k in want), key=repr)
    texts = []
    for (i, t), (_, _, k) in zip(rows, want, strict=True):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n in k or not WORD.search(x))
        texts.append((i, left, len(left or "")))
    deduped = line_dedup.dedup_lines(docs)
    assert deduped.columns == docs.columns
    assert all(r[3:] == ("k", "l", 5, "p", 1, 2, 3, 4, 5, "d") for r in deduped.collect())
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in deduped.collect()), key=repr) == sorted(texts, key=repr)


LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (3, "a b c d e\nfirst line\n\n  \nfirst  line"), (1, "a b c d e f\nx"), (2, "a b c d\ny y y\ny"), (7, None), (8, ""),
    (9, " lead tail \nlead tail\r"), (9, " lead tail \nlead tail\r"), (9, "other text of nine"), (None, "lead\nnull id"),
    (10, LONG), (11, LONG.replace("w7 ", "v ")), (12, LONG + " " + LONG.replace("w", "u")), (13, "é ß 日本\t😀"), (14, "😀 é ß 日本"),
    (15, "\n".join(f"line {i} of many {i * i} words" for i in range(400))), (16, "z" * 20_000 + "\n" + "q " * 9000),
]


def test_small_documents(spark):
    check(spark, ROWS)


def test_nothing(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_chains_and_near_copies(spark):
    words = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(20)]
    rows += [(100 + i, " ".join([*(w for j, w in enumerate(words) if j % 29 != i % 29), f"n{i}"])) for i in range(60)]
    check(spark, rows)


def test_long_lines_that_share_little_are_no_candidates(spark):
    """Long lines differ in more words than 64 bits can tell; a wider sketch keeps them apart."""
    rows = [(i, " ".join(["rare", *(f"w{i}x{k}" for k in range(120 + 10 * i))])) for i in range(9)]
    rows.append((20, rows[3][1] + " more"))
    sets = line_dedup.line_sets(frame(spark, rows)).selectExpr("*", "true AS asks")
    assert {len(r.wide) for r in sets.collect()} == {4, 8}
    found = line_dedup._candidates(sets).collect()
    assert [(r.x_doc, r.y_doc) for r in found] == [(20, 3)]


def test_near_copies_look_past_sets_of_other_sizes(spark):
    """Each word is a line of its own before the near copies, which yet meet the earliest of them."""
    words = [f"c{i}" for i in range(40)]
    rows = [(0, "\n".join(words))]
    rows += [(1 + i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])) for i in range(20)]
    looks = line_dedup._first_looks(line_dedup.line_sets(frame(spark, rows))).collect()
    assert {(r.x_doc, r.y_doc) for r in looks if r.y_doc == 1} == {(i, 1) for i in range(2, 21)}
    check(spark, rows)


def test_near_copies_look_past_other_lines_under_their_common_words(spark):
    """The last prefix keys of the near copies are those of earlier lines of their size too."""
    common = [f"f{i}" for i in range(50)]
    rows = [(i, " ".join([*common, *(f"u{i}x{k}" for k in range(10))])) for i in range(10)]
    rows += [(100 + i, " ".join([*(f"b{k}" for k in range(9)), *common, f"own{i}"])) for i in range(20)]
    looks = line_dedup._first_looks(line_dedup.line_sets(frame(spark, rows))).collect()
    assert {(100 + i, 100) for i in range(1, 20)} <= {(r.x_doc, r.y_doc) for r in looks}
    check(spark, rows)


def test_long_lines_that_share_little_are_no_looks(spark):
    rare, own = [f"r{k}" for k in range(30)], [[f"s{i}x{k}" for k in range(120)] for i in range(8)]
    rows = [(i, " ".join(rare + words)) for i, words in enumerate(own)]
    rows += [(10 + i, "\n".join([" ".join([*words, *(f"q{i}x{k}" for k in range(60))])] * 20)) for i, words in enumerate(own)]
    looks = line_dedup._first_looks(line_dedup.line_sets(frame(spark, rows))).collect()
    assert not looks
    check(spark, rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=9).map(" ".join), max_size=6).map("\n".join), max_size=12))
def test_any_lines(spark, texts):
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_given_tables(spark, scale):
    sf_dir = str(TESTDATA / scale)
    rows = [(r.doc_id, r.text) for r in registry.table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, registry.op10_line_dedup(spark, sf_dir).collect()))
    want = sorted((i, n, len(k), ",".join(map(str, k))) for i, n, k in expected(rows))
    assert got == want
    assert sum(r[2] for r in got) < sum(r[1] for r in got)


def test_no_python_in_the_plan(spark, capsys):
    line_dedup.dedup_lines(frame(spark, ROWS)).explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)
