"""The pipeline against plain Python, stage by stage, each on its own input."""

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import TESTDATA
from test_line_dedup import WORD
from test_line_dedup import expected as expected_lines
from test_mixing_sharding import targets
from test_simhash import expected as expected_groups
from test_simhash import groups as join_groups
from test_simhash import plain_fingerprint
from test_tokens import check_packing, crc, ids_of

import __spark_entry__ as entry_points
import corpus_pipeline
from pulseplan.llm import registry, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = str(TESTDATA / "sf0.001")


def plain_score(model, text):
    words = text.lower().split()
    parts = [words[i : i + 2] for i in range(max(1, len(words) - 1))] if words else []
    odds = [sum(model.weights[toxicity.subwords(w)].mean() for w in p) / len(p) for p in parts]
    return max(odds, default=0) + model.bias


def copies(doc_id, text, number, rate):
    told = hashlib.md5((text or "").encode()).hexdigest()
    digits = hashlib.md5(f"17:{'null' if doc_id is None else doc_id}:{told}:{number}".encode()).hexdigest()[:13]
    return int(rate) + (int(digits, 16) / 2**52 < rate - int(rate))


def groups_of(rows):
    """(doc_id, text, smallest id of the group) of each row, in the given order."""
    fps = [plain_fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
    return [(r[0], r[1], c) for r, c in zip(rows, join_groups([r[0] for r in rows], near), strict=True)]


def stages(spark, docs, sf_dir, path):
    """Runs the stages as the tool does, and gives each one's input and output."""
    found = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(path / str(k))
        stage(spark, docs, sf_dir).write.parquet(out)
        after = spark.read.parquet(out)
        found.append((name, docs, after))
        docs = after
    return found


@pytest.mark.parametrize("extra", [False, True])
def test_stages(spark, tmp_path, extra):
    docs = registry.table(spark, SF, "documents")
    if extra:  # nulls, empty and repeated rows beside the given ones
        more = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, " \n", None, "src1", 2), (None, "only here, alone", "en", "zz", 1)]
        docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.limit(20))
    found = stages(spark, docs, SF, tmp_path)
    plain = [(n, [tuple(r) for r in a.select(*COLUMNS).collect()], b) for n, a, b in found]
    for _, _, after in plain[:-1]:
        assert after.columns == COLUMNS

    name, rows, after = plain[0]
    model = toxicity.fit(found[0][1], registry.table(spark, SF, "labels"), ~toxicity.held_out())
    odds = {r: plain_score(model, r[1] or "") for r in set(rows)}
    sure = {r for r in odds if abs(odds[r] + 0.8472979) > 1e-3}
    got = Counter(map(tuple, after.collect()))
    assert {r: n for r, n in got.items() if r in sure} == {r: n for r, n in Counter(rows).items() if r in sure and odds[r] < -0.8472979}
    assert len(after.collect()) < len(rows)

    name, rows, after = plain[1]
    want = []
    for r, (_, _, kept) in zip(rows, expected_lines([x[:2] for x in rows]), strict=True):
        text = None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n in kept or not WORD.search(x))
        want.append((r[0], text, r[2], r[3], len(text or "")))
    assert Counter(map(tuple, after.collect())) == Counter(want)

    name, rows, after = plain[2]
    groups = expected_groups([x[:2] for x in rows], simhash.SHINGLE, simhash.RADIUS)
    component = {(i, f"{plain_fingerprint(t):016x}"): c for (i, t, *_), (_, _, c) in zip(rows, groups_of(rows), strict=True)}
    got = [tuple(r) for r in after.select(*COLUMNS).collect()]
    assert not Counter(got) - Counter(rows)
    # One row of each group, with the group's smallest id.
    of_group = Counter(component[(r[0], f"{plain_fingerprint(r[1]):016x}")] for r in got)
    assert all(r[0] == component[(r[0], f"{plain_fingerprint(r[1]):016x}")] for r in got)
    assert set(of_group) == {c for _, _, c in groups}
    assert all(n == 1 for c, n in of_group.items() if c is not None)

    name, rows, after = plain[3]
    words = Counter()
    for r in rows:
        words[r[3]] += len(WORD.findall(r[1] or ""))
    goal = targets(words)
    want, met = Counter(), Counter()
    for r in rows:
        same = (r[0], r[3], r[1] or "")
        want[r] += copies(r[0], r[1], met[same], goal[r[3]] / words[r[3]] if words[r[3]] else 0)
        met[same] += 1
    assert Counter(map(tuple, after.collect())) == +want

    name, rows, after = plain[4]
    pieces = []
    for r in rows:
        ids = [*ids_of(r[1]), 1]
        pieces += [(r[0], p // 4096, p, len(ids[p : p + 4096]), crc(ids[p : p + 4096])) for p in range(0, len(ids), 4096)]
    got = [r for r in after.collect()]
    no_id = [p for p in pieces if p[0] is None]
    assert len([r for r in got if r.doc_id is None]) == len(no_id)
    if not no_id:
        check_packing(got, pieces, 4096)
    totals = defaultdict(int)
    for r in got:
        totals[r.sequence_id] += r.length
    assert max(totals.values()) <= 4096 and sum(totals.values()) == sum(p[3] for p in pieces)


def test_pipeline_over_no_documents(spark, tmp_path):
    docs = registry.table(spark, SF, "documents").limit(0)
    for _, _, after in stages(spark, docs, SF, tmp_path):
        assert after.collect() == []


def test_pipeline_is_registered(spark):
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0
