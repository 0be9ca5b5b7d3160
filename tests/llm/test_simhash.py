"""SimHash groups against a comparison of every two fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseplan.llm import registry, simhash
from pulseplan.llm.components import connected_components


def plain_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """Smallest id reachable for each position."""
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def expected(rows, size=3, radius=2):
    fps = [plain_fingerprint(t, size) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    return sorted(
        zip([r[0] for r in rows], [f"{f:016x}" for f in fps], groups([r[0] for r in rows], near), strict=True), key=repr
    )


def check(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, fp int, node string, label int")
    assert sorted(map(tuple, simhash.digests(frame, **how).collect()), key=repr) == expected(rows, **how)


def test_small_documents(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until it sleeps " * 8
    check(spark, [
        (5, base), (3, base), (9, base.upper()), (7, base + "end"), (1, None), (4, ""), (2, " \n"),
        (6, "one"), (8, "one two"), (10, "ONE two three"), (10, "ONE two three"), (None, "one two three"), (None, "alone here now"),
        (11, "É ß é \x1f x"), (12, base.replace("fox", "cat")), (13, "w" * 40_000),
    ])


def test_nothing(spark):
    check(spark, [])


def test_first_of_groups(spark):
    """One row of each group stays, of null and repeated ids too; columns keep their values."""
    base = "the quick brown fox jumps over the lazy dog again and again until it sleeps " * 8
    schema = "doc_id long, text string, fp int, node string, label int, key1 string, times int, first int, doc string"
    rows = [
        (5, base), (3, base), (3, base), (None, base.upper()), (None, "null alone"), (None, "null alone"), (None, "another null"),
        (7, "seven"), (7, "of the same id"), (8, "eight"), (9, None), (10, ""),
    ]
    frame = spark.createDataFrame([(*r, 1, "n", n, "k", 2, 3, "d") for n, r in enumerate(rows)], schema)
    got = simhash.first_of_groups(frame)
    assert got.schema == frame.schema
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(3, base), (None, "null alone"), (None, "another null"), (7, "seven"), (7, "of the same id"), (8, "eight"), (9, None)], key=repr)
    assert simhash.first_of_groups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_given_tables(spark, radius):
    rows = [(r.doc_id, r.text) for r in registry.table(spark, str(TESTDATA / "sf0.001"), "documents").collect()]
    check(spark, rows, radius=radius)


def test_query_over_whole_documents(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    rows = [(r.doc_id, r.text) for r in registry.table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, registry.op9_simhash_groups(spark, sf_dir).collect()), key=repr)
    assert got == expected(rows)
    assert any(i != c for i, _, c in got)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 3), st.sets(st.integers(0, 63), max_size=4)), max_size=150))
def test_bit_sliced_pairs(radius, spread):
    bases = [0, (1 << 64) - 1, 0x123456789ABCDEF0, 0x0F0F0F0F0F0F0F0F]
    fps = [bases[b] ^ sum(1 << f for f in flips) for b, flips in spread]
    got = {(i, j) for a, b in simhash.near_pairs(np.array(fps, dtype=np.uint64), radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= radius}


def test_a_crowded_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    fps = {0xABCDEF0123456789 >> 1}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(12) ^ 1 << rng.randrange(12))
    fps |= {rng.getrandbits(63) for _ in range(200)}
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    position = {f: i for i, f in enumerate(fps)}
    near = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert groups(fps, [(position[r.a], position[r.b]) for r in links]) == groups(fps, near)


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)],
    [(i, j) for i in range(15) for j in range(15)] + [(99, 100), (100, 99), (-5, 14)],
])
def test_components(spark, links):
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    assert sorted(r.node for r in found) == nodes
    at = {n: i for i, n in enumerate(nodes)}
    want = dict(zip(nodes, groups(nodes, [(at[a], at[b]) for a, b in links if a != b]), strict=True))
    least = {}
    for r in found:
        least[r.label] = min(least.get(r.label, r.node), r.node)
    assert {r.node: least[r.label] for r in found} == want
