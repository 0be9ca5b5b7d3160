"""Mixing against a fixed-point iteration; shards against the laws they must obey."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

import oracle
from pulseplan.llm import copies, mixing, registry, sharding

SF = str(TESTDATA / "sf0.001")
SCHEMA = "doc_id long, text string, source string, size string, rate string, shard string, target int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 5) for r in rows], SCHEMA)


def targets(sizes, weights=(3, 1, 2), total=1.5, bound=2.0):
    """Shares by weight; what is above its bound is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, whole = set(), total * sum(sizes.values())
    while True:
        rest = whole - sum(bound * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and rest * weight[s] / open_weight > bound * sizes[s]}
        if not new:
            return {
                s: bound * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names
            }
        capped |= new


ROWS = [
    (1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "d e f", None), (None, "g h", "s3"),
    (5, "x " * 900, "s3"), (5, "x " * 900, "s3"), (6, "q w e r t y", "ß"), (7, " \t ", "empty"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[2:3], ROWS[:1], [(i, "w " * (i % 9), f"s{i % 7}") for i in range(800)]])
def test_mixing_plan_follows_the_targets(spark, rows):
    got = mixing.mixing_plan(docs(spark, rows)).collect()
    words = Counter()
    for _, t, s in rows:
        words[s] += len(WORDS.findall(t or ""))
    want = targets(words)
    assert len(got) == len(rows)
    by_size = Counter((r.source_size, round(r.target, 6)) for r in got)
    assert by_size == Counter((words[s], round(want[s], 6)) for _, _, s in rows)
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (r.size * int(rate + 1e-9), r.size * (int(rate + 1e-9) + 1)) and r.taken <= 2 * r.size


def test_mix_repeats_whole_documents(spark):
    rows = docs(spark, ROWS)
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    plan = Counter()
    for r in mixing.mixing_plan(rows).collect():
        plan[r.doc_id] += r.copies
    got = Counter()
    for (i, _), n in times.items():
        got[i] += n
    assert got == +plan


def test_extra_columns_keep_their_values(spark):
    names = ["mix_source", "mix_size", "mix_rate", "mix_time", "mix_copies", "text_md5", "rc_key1", "rc_number", "doc", "time"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    rows = spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], schema)
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns
    got = mixed.collect()
    assert got and all(tuple(r[3:]) == tuple(range(len(names))) for r in got)
    plain = mixing.mix(docs(spark, ROWS)).collect()
    assert Counter(r[:3] for r in got) == Counter(r[:3] for r in plain)
    narrow = spark.createDataFrame([(i, 7, 8, 9) for i in range(50)], "doc_id long, rc_key1 int, sh_block int, sh_part int")
    sharded = sharding.shard_uniformly(narrow, block_rows=8)
    assert sharded.columns == [*narrow.columns, "shard", "slot"]
    assert all(r[1:4] == (7, 8, 9) for r in sharded.collect())


# A third of the rows without an id, and a third that repeat one row.
HOT = [(i, f"t{i} a b c", "s1") for i in range(1000)] + [(None, f"n{i} a b c", "s1") for i in range(1000)]
HOT += [(None, "the same again and again", "s1")] * 1000 + [(i, "w " * (1 + i % 4), "s2") for i in range(3000, 4500)]


def test_rows_without_an_id_and_repeated_rows_meet_the_targets(spark):
    rows = docs(spark, HOT).repartition(5)
    got = mixing.mixing_plan(rows).collect()
    for hot in (lambda r: r.size == 5, lambda r: r.doc_id is None and r.size == 4, lambda r: True):
        taken, wanted = Counter(), Counter()
        for r in filter(hot, got):
            taken[r.source_size] += r.taken
            wanted[r.source_size] += r.size * r.target / r.source_size
        assert all(abs(taken[s] / wanted[s] - 1) < 0.1 for s in wanted)
    again = mixing.mixing_plan(docs(spark, HOT).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_numbers_of_equal_rows(spark):
    rows = docs(spark, HOT).repartition(6).select("doc_id", "text")
    numbers = defaultdict(list)
    for r in copies.numbered(rows, ["doc_id", "text"]).collect():
        numbers[r.doc_id, r.text].append(r.rc_number)
    assert {k: sorted(v) for k, v in numbers.items()} == {
        k: list(range(n)) for k, n in Counter(r[:2] for r in HOT).items()
    }


def test_repeated_rows_are_dealt_into_all_blocks(spark):
    rows = [(None, "same", "s")] * 2000 + [(i, "other", "s") for i in range(1000)]
    frame = docs(spark, rows).repartition(4)
    check_shards(sharding.shard_documents(frame).collect(), rows)
    keyed = copies.numbered(sharding.document_digests(frame), ["doc_id", "size", "text_crc32"])
    block = F.pmod(sharding._hashed(29, 0), F.lit(10))
    sizes = [r["count"] for r in keyed.groupBy(block).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400


def test_mixing_of_nothing(spark):
    assert mixing.mixing_plan(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [])).collect() == []


def test_taken_words_come_near_the_targets(spark):
    got = registry.op1_source_mixing(spark, str(TESTDATA / "sf0.1")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] / target[s] - 1) < 0.15 for s in target)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mixing_matches_sql(spark, scale):
    sf_dir = str(TESTDATA / scale)
    query = registry.op1_source_mixing(spark, sf_dir)
    assert oracle.compare(query, oracle.connect(sf_dir), mixing.MIXING_SQL) == []


def check_shards(got, rows, shards=8):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS, [(i // 2, f"t{i % 5}", "s") for i in range(3000)]])
def test_shards_obey_their_law(spark, rows):
    check_shards(sharding.shard_documents(docs(spark, rows)).collect(), rows)


def test_shards_with_many_blocks(spark):
    rows = [(i, str(i), "s") for i in range(4000)]
    narrow = sharding.document_digests(docs(spark, rows))
    got = sharding.shard_uniformly(narrow, block_rows=50).collect()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert Counter(r.shard for r in got) == Counter({s: 500 for s in range(8)})
    rises = sum(a.doc_id < b.doc_id for a, b in zip(order, order[1:], strict=False))
    assert abs(rises - 2000) < 100


def test_shards_run_no_python(spark, capsys):
    sharding.shard_documents(docs(spark, ROWS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_hypergeometric_law():
    rng = random.Random(5)
    got = [sharding.hypergeometric(30, 70, 20, rng) for _ in range(20_000)]
    assert abs(sum(got) / len(got) - 6) < 0.05
    var = sum((g - 6) ** 2 for g in got) / len(got)
    assert abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert all(sharding.hypergeometric(5, 0, 3, rng) == 3 for _ in range(9))
    big = [sharding.hypergeometric(10**10, 7 * 10**10, 1_800_000, rng) for _ in range(50)]
    assert abs(sum(big) / 50 - 225_000) < 400


def test_communication_matrix_has_its_sums():
    m = sharding.communication_matrix([7, 0, 100, 13], [60, 60], 1)
    assert [sum(r) for r in m] == [7, 0, 100, 13] and [sum(c) for c in zip(*m, strict=True)] == [60, 60]
