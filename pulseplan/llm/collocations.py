"""Phrase collocations by marginalising counts of the longest word windows.

Texts are cut at punctuation into pieces and these into words. A word and the four behind it
in its piece stand side by side as five columns, padded behind the piece's end: one row a
word. Only these longest windows are counted, and a ROLLUP over the columns sums the
counts of each shorter prefix, so phrases of all lengths come from one set of rows. The
columns are taken from the piece's words where they lie, which gives what ``lead`` over
the piece gives, without shuffling and sorting all words for it.

A phrase of at least ``least`` occurrences is made of words and of pairs with as many. So
words are counted first, then pairs of frequent words, and the longest windows are cut
(padded) at the first pair that is not frequent. That drops no phrase that counts, and
leaves so few different windows that they combine in each task. Texts are read twice: to
count their words, and to write the frequent words as numbers, with ``NONE`` for others and
between pieces. Both passes cut whole batches of texts by their bytes. From there on words are
numbers; pairs and windows are counted in parts by their first words, so that only a part of
them is on disk at once, windows as numbers of their pairs, and frequent phrases are spelled
out at the end.

Frequent words, and frequent pairs, go to all tasks if, when measured, they take at most
``BROADCAST_BYTES``; otherwise they are joined by shuffles, whose hot keys adaptive execution
splits.

Scores are exact: products are decimals of 38 digits.

Nulls: a null text is empty, a null language is `und`. Rows that repeat each other count as
often as they occur; a null or repeated document id means nothing here. Pieces without
words give nothing, nor does an empty table. Very long pieces are read in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import TEXT_BATCH, stored
from .tokens import steps

LONGEST = 5
LEAST = 100
STRETCH = 1024
BROADCAST_BYTES = 64 << 20
# Parts, by first words, in which pairs and windows are counted one after the other.
PAIR_SLICES, WINDOW_SLICES = 4, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = r"[.,;:!?\x0A-\x0D]"
_BLANKS = r"[\x20\x09]+"
_ROW_BYTES = 64
# What stands for words that are not frequent, and between pieces.
NONE = -1
# Bytes of words, of blanks and of ends of pieces; letters A-Z become a-z.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOW_BYTES = np.arange(256, dtype=np.uint8)
_LOW_BYTES[ord("A") : ord("Z") + 1] += 32


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words) of each piece that has words."""
    low = F.translate("text", _UPPER, _LOWER)
    cut = _texts(docs).select("lang", F.explode(F.split(low, _ENDS, -1)).alias("piece"))
    found = cut.select("lang", F.array_remove(F.split("piece", _BLANKS, -1), "").alias("words"))
    return found.filter(F.size("words") > 0)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts in a row; the row of each, and whether it is its piece's first.

    As `pieces` cuts them. All marks are single bytes in UTF-8, so bytes are looked at, not characters.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kinds = _KINDS[data]
    inside = kinds == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = inside[heads]
    first = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[first] - 1, np.count_nonzero(inside))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(_LOW_BYTES[data[inside]])]
    words = pa.Array.from_buffers(pa.large_string(), len(first), buffers)
    row = np.searchsorted(ends, first, side="right") - 1
    piece = np.cumsum(kinds == 2, dtype=np.int64)[first]
    opens = np.ones(len(first), dtype=bool)
    opens[1:] = (np.diff(row) > 0) | (np.diff(piece) > 0)
    return words, row, opens


def _coded(part: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different languages and words of a batch, and of each word its row, its place among those and ``opens``."""
    words, row, opens = cut_words(part.column("text"))
    lang, word = part.column("lang").dictionary_encode(), words.dictionary_encode()
    codes = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    langs = lang.indices.to_numpy(zero_copy_only=False)[row]
    return lang.dictionary, word.dictionary, row, langs * len(word.dictionary) + codes, opens


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            langs, words, _, codes, _ = _coded(part)
            found, counts = np.unique(codes, return_counts=True)
            size = max(len(words), 1)
            own = {"lang": langs.take(pa.array(found // size)), "word": words.take(pa.array(found % size))}
            columns = {c: v.cast(pa.string()) for c, v in own.items()}
            yield pa.record_batch(columns | {"count": pa.array(counts, pa.int64())})


def _numbers(vocabulary: dict[str, tuple[pa.Array, np.ndarray]], langs: pa.Array, words: pa.Array) -> np.ndarray:
    """The number of each word in each language, or ``NONE``."""
    table = np.full((len(langs), len(words)), NONE, dtype=np.int32)
    for at, lang in enumerate(langs.to_pylist()):
        if lang in vocabulary:
            known, numbers = vocabulary[lang]
            place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            table[at] = np.where(place >= 0, numbers[place], NONE)
    return table.reshape(-1)


def _numbered_texts(part: pa.RecordBatch, vocabulary: dict[str, tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    langs, words, row, codes, opens = _coded(part)
    spread = np.full(len(codes) + np.count_nonzero(opens), NONE, dtype=np.int32)
    spread[np.arange(len(codes)) + np.cumsum(opens)] = _numbers(vocabulary, langs, words)[codes]
    rows = np.repeat(row, 1 + opens)
    # A word between two that are not frequent is in no pair, and one NONE is as good as many.
    none = np.zeros(1, dtype=bool)
    around = np.concatenate((none, spread >= 0, none))
    paired = around[1:-1] & (around[:-2] | around[2:])
    keep = paired | np.concatenate((none, paired))[:-1]
    spread = np.where(paired, spread, NONE)[keep]
    sizes = np.bincount(rows[keep], minlength=part.num_rows)
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.record_batch({"words": pa.ListArray.from_arrays(offsets, pa.array(spread, pa.int32()))})


def lead_windows(found: DataFrame, order: int) -> DataFrame:
    """w1, ... and what else ``found`` has: each word and those behind it in its piece; null behind the end."""
    others = [c for c in found.columns if c != "words"]
    # A stretch has the words that windows begin with, and those that its last windows reach.
    stretch = F.transform(
        F.sequence(F.lit(1), F.size("words"), F.lit(STRETCH)),
        lambda a: F.slice("words", a, F.lit(STRETCH + order - 1)),
    )
    parts = F.when(F.size("words") > STRETCH, stretch).otherwise(F.array("words"))
    cut = found.select(*others, F.explode(parts).alias("part"))
    begun = F.least(F.size("part"), F.lit(STRETCH))
    columns = [F.slice("part", F.lit(k), begun) for k in range(1, order + 1)]
    names = [f"w{k}" for k in range(1, order + 1)]
    return cut.select(*others, F.inline(F.arrays_zip(*columns)).alias(*names))


def prefix_counts(windows: DataFrame, order: int, blank: str | int = "") -> DataFrame:
    """(lang, words, f) of all prefixes of the counted windows (lang, w1, ..., count).

    ``blank``: what is no word, to pad with; words may also be numbers.
    """
    columns = [f"w{k + 1}" for k in range(order)]
    padded = windows.na.fill(blank, columns)
    longest = padded.groupBy("lang", *columns).agg(F.sum("count").alias("count"))
    summed = longest.rollup("lang", *columns).agg(
        F.sum("count").alias("f"), F.grouping_id().alias("level")
    )
    # A prefix of k words is summed over the last order - k columns, whose bits are set.
    size = F.lit(order) - F.bit_count("level")
    own = F.slice(F.array(*columns), F.lit(1), size)
    named = summed.filter(F.col("level") < (1 << order) - 1).select("lang", own.alias("words"), "f")
    return named.filter(F.element_at("words", -1) != blank)


def _bounded(table: DataFrame, *texts: str) -> bool:
    """Whether ``table`` (stored) is small enough to go to all tasks."""
    size = sum((F.octet_length(c) for c in texts), F.lit(_ROW_BYTES))
    return (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    counted = _texts(docs).mapInArrow(_counted_words, "lang string, word string, count long")
    return stored(counted.groupBy("lang", "word").agg(F.sum("count").alias("f")), "words", TEXT_BATCH)


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of words with ``least`` occurrences; ``id`` numbers the rows from 0."""
    place = F.monotonically_increasing_id()
    rows = stored(words.filter(F.col("f") >= least).withColumn("place", place), "vocabulary")
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("many")).collect()
    before, total = {}, 0
    for number, many in sorted(map(tuple, sizes)):
        before[number], total = total, total + many
    starts = rows.sparkSession.createDataFrame([*before.items()], "part long, start long")
    at = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    joined = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return stored(joined.select("lang", "word", "f", at.cast("int").alias("id")), "vocabulary")


def word_numbers(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``words``, the numbers of the words of one or more pieces; ``NONE`` between pieces and for other words."""
    if not _bounded(vocabulary, "lang", "word"):
        return stored(_joined_numbers(docs, vocabulary), "numbers", codec="zstd")
    rows = vocabulary.select("lang", "word", "id").toArrow()
    own = {}
    for lang in pc.unique(rows.column("lang")).to_pylist():
        mine = rows.filter(pc.equal(rows.column("lang"), lang))
        word = mine.column("word").cast(pa.large_string()).combine_chunks()
        own[lang] = (word, mine.column("id").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                yield _numbered_texts(part, sent.value)

    numbered = _texts(docs).mapInArrow(mapper, "words array<int>")
    return stored(numbered.filter(F.size("words") > 1), "numbers", TEXT_BATCH, "zstd")


def _joined_numbers(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`word_numbers` by a join, for vocabularies that are too large for a task."""
    found = stored(pieces(docs).withColumn("piece", F.monotonically_increasing_id()), "pieces", codec="zstd")
    words = found.select("lang", "piece", F.posexplode("words").alias("at", "word"))
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left")
    numbers = F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(NONE)).alias("id"))))
    return known.groupBy("piece").agg(numbers.alias("numbers")).select(F.col("numbers.id").alias("words"))


def _sliced(windows: DataFrame, number: int, slices: int) -> DataFrame:
    """One of several parts, by the first word, so that a phrase occurs in one part only."""
    return windows.filter(F.pmod(F.xxhash64("w1"), F.lit(slices)) == number)


def frequent_pairs(found: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, n1, n2, id) of pairs with ``least`` occurrences: words, their numbers, and any own number."""
    windows = lead_windows(found, 2).filter((F.col("w1") >= 0) & (F.col("w2") >= 0))
    frequent = None
    for number in range(PAIR_SLICES):
        ids = _sliced(windows, number, PAIR_SLICES)
        counted = ids.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("f"))
        part = stored(counted.filter(F.col("f") >= least), "counted-pairs")
        frequent = part if frequent is None else frequent.unionByName(part)
    numbers = frequent.select(F.col("w1").alias("n1"), F.col("w2").alias("n2"))
    first = vocabulary.select("lang", F.col("word").alias("w1"), F.col("id").alias("n1"))
    second = vocabulary.select(F.col("word").alias("w2"), F.col("id").alias("n2"))
    named = numbers.join(first, "n1").join(second, "n2")
    return stored(named.select("lang", "w1", "w2", "n1", "n2", F.monotonically_increasing_id().alias("id")), "pairs")


def cut_windows(windows: DataFrame, pairs: DataFrame, order: int) -> DataFrame:
    """(lang, w1, ..., count): for each window its pairs' numbers, null from the first that is not frequent.

    Only windows that begin with a frequent pair; there is one number less than words.
    """
    rows = windows.filter((F.col("w1") >= 0) & (F.col("w2") >= 0))
    for k in range(2, order + 1):
        left, right = f"w{k - 1}", f"w{k}"
        own = [F.col("lang")] if k == 2 else []
        mine = pairs.select(*own, F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("id").alias(f"pair{k}"))
        here = (F.col(left) == F.col("p1")) & (F.col(right) == F.col("p2"))
        rows = rows.join(mine, here, "left" if k > 2 else "inner").drop("p1", "p2")
        rows = rows.withColumn(right, F.when(F.isnotnull(f"pair{k}"), F.col(right)))
    numbers = [F.col(f"pair{k}").alias(f"w{k - 1}") for k in range(2, order + 1)]
    return rows.select("lang", *numbers, F.lit(1).cast("long").alias("count"))


def _spelled(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, words, f) of phrases whose ``words`` are numbers of pairs."""
    one = phrases.select("lang", "f", F.col("words").alias("ids"), F.posexplode("words").alias("at", "id"))
    both = one.join(pairs.select("id", "w1", "w2"), "id")
    parts = F.array_sort(F.collect_list(F.struct("at", "w1", "w2")))
    own = both.groupBy("lang", "ids", "f").agg(parts.alias("parts"))
    words = F.concat(F.array(F.col("parts")[0]["w1"]), F.col("parts")["w2"])
    return own.select("lang", words.alias("words"), "f")


def phrase_counts(found: DataFrame, vocabulary: DataFrame, least: int, order: int) -> DataFrame:
    """(lang, words, f) of all phrases of 1 to ``order`` words with ``least`` occurrences."""
    pairs = frequent_pairs(found, vocabulary, least)
    known = F.broadcast(pairs) if _bounded(pairs, "lang") else pairs
    windows = lead_windows(found, order)
    phrases = vocabulary.select("lang", F.array("word").alias("words"), "f")
    for number in range(WINDOW_SLICES):
        cut = cut_windows(_sliced(windows, number, WINDOW_SLICES), known, order)
        frequent = prefix_counts(cut, order - 1, -1).filter(F.col("f") >= least)
        phrases = phrases.unionByName(_spelled(stored(frequent, "counted-windows"), pairs))
    return stored(phrases, "phrases")


def _phrase(words: Column | str) -> Column:
    return F.array_join(words, " ")


def _exact(number: str) -> Column:
    return F.col(number).cast("decimal(19,0)")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of candidates by their lowest-scoring cut.

    ``phrases``: as `phrase_counts` gives; ``totals``: (lang, n).
    """
    several = phrases.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    cut = several.select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    cut = cut.select(
        "*",
        _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("left"),
        _phrase(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"),
    )
    counts = phrases.select("lang", _phrase("words").alias("part"), "f")
    with_l = cut.join(counts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
    both = with_l.join(counts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    known = both.join(totals, "lang")
    score = F.call_function(
        "div", F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n")), _exact("l") * _exact("r")
    )
    known = known.withColumn("score", score)
    lowest = known.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("lang", _phrase("words").alias("phrase"), "words", "a", "m.l", "m.r", "n", "m.score")


def not_absorbed(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases that a longer candidate holds nearly as often: ``percent`` of their count."""
    longer = candidates.filter(F.size("words") > 2).select("lang", "words", "a")
    size = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda at: _phrase(F.slice("words", at, n))
            ),
        )
    )
    held = longer.select("lang", F.explode(inner).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = candidates.join(held, ["lang", "phrase"], "left")
    absorbed = F.lit(100) * F.col("most") >= F.lit(percent) * F.col("a")
    return joined.filter(~F.coalesce(absorbed, F.lit(False))).drop("most")


def collocations(
    docs: DataFrame, top: int = 2000, least: int = LEAST, percent: int = 100, order: int = LONGEST
) -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    words = word_counts(docs)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = frequent_words(words, least)
    phrases = phrase_counts(word_numbers(docs, vocabulary), vocabulary, least, order)
    left = not_absorbed(stored(scored(phrases, totals), "candidates"), percent)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM words
), grams AS (
  SELECT lang, w[pos:pos + k - 1] AS g, CAST(count(*) AS HUGEINT) AS f
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE pos + k - 1 <= len(w) GROUP BY 1, 2
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE len(g) = 1 GROUP BY lang
), candidates AS (
  SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
  JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_sizes AS (
  SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM candidates
), inner_places AS (
  SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS pos FROM inner_sizes
), held AS (
  SELECT lang, g[pos:pos + m - 1] AS g, max(a) AS most FROM inner_places GROUP BY 1, 2
), left_over AS (
  SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM left_over
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
