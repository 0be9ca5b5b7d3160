"""Benchmark decontamination by a broadcast hash set of word windows, in DataFrame functions only.

Words are lower-cased runs of letters, digits and characters beyond ASCII. A benchmark item
gives each of its windows of ``size`` consecutive words, or all its words as one window if
it has fewer. The distinct windows are broadcast as the hash side of a join; each document
is scanned window by window, and a window counts only if its words are equal to those of
the set, not just their hash. What comes out are the hit windows alone: texts are not
shuffled, and hits combine into one row per document.

The set of windows is stored and measured before it is broadcast. If it takes more than
``SET_BYTES``, it is dealt into slices of that size by hash, and each is broadcast in a
pass of its own over the documents, so what a task holds is bounded whatever the benchmark.
Documents are scanned in stretches of ``STRETCH`` windows, so a text of any length never
has all its windows in memory. Items that share a window are listed once per set of
items, so that a phrase which all items share does not carry them all into each hit.

Nulls: a null text, of a document or an item, has no words. A null document id is kept. A
null item id marks words, but has no id to be listed or counted. Items of one id count
once. Rows that repeat each other get the same result each. Without items, or with items
without words, nothing is hit. An empty table gives no rows. Columns that a document
brings keep their names and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stored

SIZE = 10
SET_BYTES = 64 << 20
STRETCH = 512
# What a row of the set takes beside its words.
_ROW_BYTES = 96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_KEY = ["key1", "key2"]


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{_GAP}]+", -1), "")


def words(text: Column) -> Column:
    """The lower-cased words of a text; none of a null one."""
    return _split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER))


def benchmark_windows(
    benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(window, length, item): the distinct windows of each item, with its id as text."""
    own = words(F.col(text_col))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), own.alias("words"))
    items = items.withColumn("length", F.least(F.size("words"), F.lit(size))).filter("length > 0")
    at = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    each = F.transform(at, lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))
    return items.select(F.explode(each).alias("window"), "length", "item").distinct()


def _keys(doc_id: str, text: str) -> list[Column]:
    """What tells documents apart: 128 bits of the id and the whole text."""
    both = [F.col(doc_id).cast("string"), F.col(text).cast("string")]
    return [
        F.xxhash64(F.lit(n), F.isnull(both[0]), *both).alias(name) for n, name in enumerate(_KEY)
    ]


def _hash(columns: list) -> Column:
    return F.xxhash64(F.lit(len(columns)), *columns)


def _lead_words(docs: DataFrame, widest: int) -> DataFrame:
    """key1, key2, start, w1, ...: each word of a text and those behind it; null behind the end."""
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH))
    stretch = F.transform(
        starts,
        lambda a: F.struct(
            a.alias("first"), F.slice("words", a + 1, F.lit(STRETCH + widest - 1)).alias("part")
        ),
    )
    cut = (
        docs.select(*_keys("doc_id", "text"), words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .select(*_KEY, F.inline(stretch).alias("first", "part"))
    )
    begun = F.least(F.size("part"), F.lit(STRETCH))
    columns = [F.slice("part", F.lit(k), begun) for k in range(1, widest + 1)]
    rows = cut.select(*_KEY, "first", F.posexplode(F.arrays_zip(*columns)).alias("pos", "w"))
    # Fields of a zipped array are named by their places.
    named = [F.col("w")[str(k)].alias(f"w{k + 1}") for k in range(widest)]
    return rows.select(*_KEY, (F.col("first") + F.col("pos")).alias("start"), *named)


def hit_windows(docs: DataFrame, windows: DataFrame, lengths: list[int], slices: int = 1) -> DataFrame:
    """(key1, key2, start, length, items): where a window of the set stands in a document.

    ``windows`` (window, length, items) is a set of bounded size, or ``slices`` such sets.
    """
    columns = [f"w{k}" for k in range(1, max(lengths) + 1)]
    rows = _lead_words(docs, max(lengths))
    each = [
        F.when(
            F.isnotnull(f"w{n}"),
            F.struct(F.lit(n).alias("length"), _hash(columns[:n]).alias("hash")),
        )
        for n in lengths
    ]
    if len(each) == 1:
        scanned = rows.filter(F.isnotnull(columns[-1])).withColumn("own", each[0])
    else:
        scanned = rows.withColumn("own", F.explode(F.array_compact(F.array(*each))))
    scanned = scanned.select(*_KEY, "start", *columns, "own.*")
    # The words of a window, to be put together where the hash is in the set.
    text = F.concat_ws(" ", *[F.when(F.col("length") > k, F.col(c)) for k, c in enumerate(columns)])
    # The same words, said so that they are not looked up but compared after the hash is found.
    verified = (text >= F.col("window")) & (text <= F.col("window"))
    parts = F.split("window", " ", -1)
    known = windows.select(
        "window",
        "items",
        F.col("length").alias("n"),
        F.coalesce(
            *[F.when(F.col("length") == n, _hash([parts[k] for k in range(n)])) for n in lengths]
        ).alias("known"),
    )

    def meet(n: int) -> DataFrame:
        mine = known if slices == 1 else known.filter(_slice(slices) == n)
        # Measured: a slice takes about SET_BYTES at most.
        same = (F.col("hash") == F.col("known")) & (F.col("length") >= F.col("n"))
        found = scanned.join(F.broadcast(mine), same & (F.col("length") <= F.col("n")) & verified)
        return found.select(*_KEY, "start", "length", "items")

    return reduce(DataFrame.unionByName, map(meet, range(slices)))


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("window"), F.lit(slices))


def hits(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, set_bytes: int = SET_BYTES
) -> DataFrame:
    """(key1, key2, hit, item_ids) for each hit document.

    ``hit``: the numbers of its hit words, in no order; ``item_ids``: in order, as text.
    """
    listed = benchmark_windows(benchmark, size).groupBy("window", "length")
    listed = listed.agg(F.array_sort(F.collect_set("item")).alias("list"))
    listed = stored(listed.withColumn("items", F.md5(F.to_json("list"))), "windows")
    taken = F.sum(F.octet_length("window") + F.lit(_ROW_BYTES))
    lengths, taken = listed.agg(F.collect_set("length"), taken).first()
    if not lengths:  # nothing can be hit
        lengths = [size]
    lists = listed.select("items", "list").distinct()
    item = lists.select("items", F.explode_outer("list").alias("item"))
    slices = max(1, -(-(taken or 0) // set_bytes))
    found = hit_windows(docs, listed.select("window", "length", "items"), sorted(lengths), slices)
    # Sets, which combine in each task: copies of a row add nothing.
    by_doc = found.groupBy(*_KEY).agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items")
    )
    numbers = F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)
    )
    by_doc = by_doc.select(
        *_KEY, F.array_distinct(F.flatten(numbers)).alias("hit"), F.explode("items").alias("items")
    )
    return by_doc.join(item, "items").groupBy(*_KEY).agg(
        F.first("hit").alias("hit"), F.array_sort(F.collect_set("item")).alias("item_ids")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, set_bytes: int = SET_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit and item_ids (in order, as text) for each row of ``docs``."""
    n_words = F.size(_split(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", n_words.cast("long").alias("n_words"), *_keys("doc_id", "text"))
    found = hits(docs, benchmark, size, set_bytes)
    found = found.select(*_KEY, F.size("hit").cast("long").alias("n_hit"), "item_ids")
    return rows.join(found, _KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    size: int = SIZE,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``docs`` without hit documents, or (``remove="spans"``) without the hit words.

    A hit word goes with the characters between it and the word before; ``n_chars``, if
    there, is set anew.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found = hits(docs, benchmark, size, set_bytes)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_keys("doc_id", "text"))
    if remove == "documents":
        return rows.join(found.select(*_KEY), _KEY, "left_anti").select("doc.*")
    text = F.col("doc.text").cast("string")
    pieces = F.regexp_extract_all(text, F.lit(f"[{_GAP}]*[^{_GAP}]+"), F.lit(0))
    everything = F.sequence(F.lit(0), F.size("pieces") - 1)
    stay = F.array_sort(F.array_except(everything, F.col("hit")))
    left = F.array_join(F.transform(stay, lambda i: F.get("pieces", i)), "")
    tail = F.regexp_extract(text, f"[{_GAP}]*\\z", 0)
    rows = rows.join(found.select(*_KEY, "hit"), _KEY, "left")
    rows = rows.withColumn("pieces", F.when(F.isnotnull("hit"), pieces))
    rows = rows.withColumn("left", F.when(F.isnotnull("hit"), F.concat(left, tail)).otherwise(text))
    columns = []
    for name in docs.columns:
        kept = F.col("doc")[name]
        if name == "text":
            kept = F.col("left")
        elif name == "n_chars":
            kept = F.when(F.isnotnull("hit"), F.length("left")).otherwise(kept)
        columns.append(kept.cast(docs.schema[name].dataType).alias(name))
    return rows.select(*columns)


def digests(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """What of each document is hit, and by which items, with a checksum of their ids."""
    found = contamination(docs, benchmark, size)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), iw AS (
  SELECT item, least(len(words), 10) AS length, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS pos
  FROM i WHERE len(words) > 0
), items AS (
  SELECT DISTINCT item, length, array_to_string(words[pos:pos + length - 1], ' ') AS win FROM iw
), lengths AS (
  SELECT DISTINCT length FROM items
), dw AS (
  SELECT r, words, length, unnest(range(1, len(words) - length + 2)) AS pos FROM d, lengths WHERE len(words) >= length
), found AS (
  SELECT dw.r, dw.pos, dw.length, items.item
  FROM dw JOIN items ON items.length = dw.length AND items.win = array_to_string(dw.words[dw.pos:dw.pos + dw.length - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(pos, pos + length)) AS place FROM (SELECT DISTINCT r, pos, length FROM found))
  GROUP BY r
), named AS (
  SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
