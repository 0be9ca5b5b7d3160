"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest
from conftest import TESTDATA

import oracle
from pulseplan.llm import collocations as co
from pulseplan.llm import registry

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SCHEMA = "doc_id long, text string, lang string, w1 string, words int, part int, f int, count int"


def table(spark, rows):
    return spark.createDataFrame([(n, t, y, "a", 1, 2, 3, 4) for n, (t, y) in enumerate(rows)], SCHEMA)


def brute(rows, top=2000, least=100, percent=100, order=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, order + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    absorbed = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i : i + k])
                if 100 * a >= percent * candidates[inner]:
                    absorbed.add(inner)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in absorbed:
            continue
        n = totals[lang]
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, k = min((1000 * a * n // (x * y), k) for k, (x, y) in enumerate(cuts))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), a, *cuts[k], n))
    out = []
    for lang, own in found.items():
        for rank, (s, _, phrase, a, x, y, n) in enumerate(sorted(own)[:top]):
            out.append((lang, rank + 1, phrase.decode(), a, x, y, n, -s))
    return sorted(out)


def got(frame, **options):
    return sorted(map(tuple, co.collocations(frame, **options).collect()))


def sentences(seed, many):
    rng = random.Random(seed)
    vocabulary = ["the", "cat", "sat", "on", "mat", "New", "York", "city", "ñandú", "été", "a-b", "x"]
    rows = []
    for n in range(many):
        words = rng.choices(vocabulary, weights=[9, 4, 4, 4, 3, 2, 2, 1, 2, 1, 1, 1], k=rng.randint(0, 30))
        if n % 3 == 0:
            words += ["New", "York", "City", "hall", "way"]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n"]) for w in words)
        rows.append((text, rng.choice(["en", "es", None, "und"])))
    return rows


ODD = [("", "en"), (None, "en"), (None, None), (" .,;: ", "en"), ("One", "de"), ("\x0b\x0c\r\n", "en")]


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 3, "top": 4, "percent": 80}, {"least": 2, "order": 3}, {"least": 4, "order": 2}])
def test_against_brute_force(spark, options):
    rows = sentences(1, 150) + ODD
    assert got(table(spark, rows), **options) == brute(rows, **options)


@pytest.mark.parametrize("stretch", [2, 5, 7])
def test_long_pieces_and_no_broadcast(spark, stretch, monkeypatch):
    monkeypatch.setattr(co, "STRETCH", stretch)
    monkeypatch.setattr(co, "BROADCAST_BYTES", 0)
    rows = [(t.replace(".", " ").replace(",", " ").replace("\n", " "), y) for t, y in sentences(2, 60)]
    assert got(table(spark, rows), least=3) == brute(rows, least=3)


@pytest.mark.parametrize("slices", [1, 5])
def test_parts_hold_all_phrases_of_their_first_words(spark, slices, monkeypatch):
    monkeypatch.setattr(co, "PAIR_SLICES", slices)
    monkeypatch.setattr(co, "WINDOW_SLICES", 6 - slices)
    rows = sentences(3, 60)
    assert got(table(spark, rows), least=3) == brute(rows, least=3)
    windows = co.lead_windows(co.pieces(table(spark, rows)), 3)
    parts = [co._sliced(windows, k, 5) for k in range(5)]
    assert sum(p.count() for p in parts) == windows.count()
    first = [{r.w1 for r in p.select("w1").distinct().collect()} for p in parts]
    assert sum(map(len, first)) == len(set().union(*first)) and max(map(len, first)) < len(set().union(*first))


def test_one_document_of_many_copies(spark):
    """A hot phrase: overlaps count, and equal rows count as often as they occur."""
    rows = [("go go go go go go go. the end", "en")] * 120 + [("the end", "en")] * 10
    assert got(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], ODD])
def test_nothing_to_find(spark, rows):
    assert got(table(spark, rows)) == []


def test_exact_beyond_longs(spark):
    """Products of counts of tens of millions of millions pass 64 bits."""
    big = 10**13
    phrases = spark.createDataFrame(
        [("en", ["a", "b"], big - 7), ("en", ["a"], big + 1), ("en", ["b"], big + 3)], "lang string, words array<string>, f long"
    )
    totals = spark.createDataFrame([("en", 3 * big + 11)], "lang string, n long")
    row = co.scored(phrases, totals).first()
    assert row.score == 1000 * (big - 7) * (3 * big + 11) // ((big + 1) * (big + 3))


def test_rollup_sums_the_longest_windows(spark):
    found = spark.createDataFrame([("en", ["a", "b", "a", "b", "c"])], "lang string, words array<string>")
    windows = co.lead_windows(found, 3)
    assert windows.count() == 5
    from pyspark.sql import functions as F

    counts = {tuple(r.words): r.f for r in co.prefix_counts(windows.withColumn("count", F.lit(1)), 3).collect()}
    assert counts[("a",)] == 2 and counts[("a", "b")] == 2 and counts[("a", "b", "a")] == 1
    assert counts[("b", "c")] == 1 and len(counts) == 3 + 3 + 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    sf_dir = str(TESTDATA / sf)
    found = registry.op13_collocations(spark, sf_dir)
    assert oracle.compare(found, oracle.connect(sf_dir), co.COLLOCATIONS_SQL) == []


def test_words_are_cut_in_whole_batches():
    """By bytes, as the expressions cut characters; also in slices of a larger batch."""
    import pyarrow as pa

    texts = ["", "One tWo,\tthree", "", "été\x0bÉTÉ  ñ!", "x", "y z.", " .,;: ", "日本 😀;A-B\r\nc\u00a0d", ""]
    for part in (texts, texts[1:5], texts[3:], texts[:1]):
        whole = pa.array(["before,", *texts]) if part is texts else pa.array([*texts, "behind"])
        at = 1 if part is texts else texts.index(part[0]) if part[0] else 0
        words, row, opens = co.cut_words(whole.slice(at, len(part)))
        want = []
        for n, text in enumerate(part):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(UPPER)):
                want += [(w, n, k == 0) for k, w in enumerate(re.findall(r"[^\x20\x09]+", piece))]
        assert list(zip(words.to_pylist(), row.tolist(), opens.tolist(), strict=True)) == want


@pytest.mark.parametrize("limit", [0, co.BROADCAST_BYTES])
def test_passes_read_numbers_of_frequent_words(spark, limit, monkeypatch):
    """Pairs come from arrays of ints, in which every pair of frequent words stands as often as in the texts."""
    monkeypatch.setattr(co, "BROADCAST_BYTES", limit)
    rows = [*sentences(4, 80), *ODD]
    words = co.word_counts(table(spark, rows))
    vocabulary = co.frequent_words(words, 40)
    names = {r.id: (r.lang, r.word) for r in vocabulary.collect()}
    assert sorted(names) == list(range(len(names))) and 0 < len(names) < words.count()
    found = co.word_numbers(table(spark, rows), vocabulary)
    assert found.dtypes == [("words", "array<int>")]
    pairs = Counter((r.w1, r.w2) for r in co.lead_windows(found, 2).filter("w1 >= 0 AND w2 >= 0").collect())
    want, known = Counter(), set(names.values())
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            own = [(lang or "und", w) for w in re.findall(r"[^\x20\x09]+", piece)]
            want.update(p for p in zip(own, own[1:]) if known.issuperset(p))
    assert Counter({(names[a], names[b]): f for (a, b), f in pairs.items()}) == want
