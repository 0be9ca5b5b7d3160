"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. It goes if an earlier line (by document id, then by
place) holds the same set or one of Jaccard similarity of at least 4/5, whether or not
that earlier line stays itself. Lines without words always stay.

1. Words are counted over all lines, in ``BUCKETS`` counters; a word's key begins with
   its counter's size class, so keys in ascending order go from rare to frequent words.
2. Equal sets become one: the first line that holds the set. All later ones go.
3. Sets with similarity t share a word among the first n - ceil(t n) + 1 keys of the
   larger and the first n - ceil(2 t n / (1 + t)) + 1 of the other (prefix filter). Pairs
   that share one must also fit in size (length filter), have enough words left behind
   the shared one to reach the overlap (positional filter), and differ in few bits of
   their sketches: in each of 64 bits, whether an odd number of words falls there. Sets of
   many words fill 64 bits with any other set's difference, and have wider sketches too.
4. What is left is verified on all words, by their 64-bit hashes.

The postings of the join proper take several times the disk of the sets, so they are
dealt by their keys into ``SLICES`` parts that are joined one after the other.

Near copies of one line would make a square of pairs. So each set first meets only the
earliest set of about its size under the last half of its prefix keys, a pair per key at most;
sets that go by this ask no more. The join proper then works for the others, against all sets.
The more words a set has, the more of them may lie between it and its near copies, and the
earliest set under a single key may be any other line: so longer sets look under more keys.

A frequent word is a hot key only for lines of frequent words; its group is joined by
sort and merge, which adaptive execution splits, and is gathered nowhere.

Nulls: a null text has no lines; a null document id comes first of all. Rows that repeat
a document are that document and keep and lose the same lines; rows that share an id but
not the text follow each other by their texts' checksums. An empty table gives no rows.
Columns that a document brings keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stored

BLANKS = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 17
# Similarity as a fraction: overlap >= NUM / (NUM + DEN) of both sizes together.
NUM, DEN = 4, 5
# Last keys of the prefix under which a set meets the earliest one: half of them, but so many at least.
FIRST_LOOK = 3
FILTER_BYTES = 1 << 17
# Parts of the keys that are joined one after the other.
SLICES = 4
# Words for which 64 bits are enough, and the most longs of a wider sketch.
SKETCH_WORDS, SKETCH_LONGS = 48, 8
_CLASS_BITS = 7
_HASH_BITS = 63 - _CLASS_BITS


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS, -1), "")


def _hash(word: Column) -> Column:
    return F.xxhash64(word)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place, line) of lines with words; places ascend within a text.

    A place holds the text's checksum too, so that texts of one id stay apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        F.shiftleft(F.crc32(text), 31).alias("crc"),
        F.posexplode(F.split(text, "\n", -1)).alias("number", "line"),
    )
    has_words = F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]"))
    return found.filter(has_words).select(
        "doc_id", (F.col("crc") + F.col("number")).alias("place"), "line"
    )


def _byte(table: bytes, at: Column) -> Column:
    """The byte of a fixed table, each below 128, at a number from 0."""
    one = F.substring(F.lit(table), at.cast("int") + 1, F.lit(1))
    return F.ascii(one.cast("string"))


def _as_table(values: DataFrame, size: int) -> bytes:
    """A fixed table from rows (id, value), each value below 128: size / 256 rows come here."""
    row, column = F.call_function("div", "id", F.lit(256)), (F.col("id") % 256).cast("int")
    own = F.map_from_entries(F.collect_list(F.struct(column, "value")))
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(255)),
        lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(own, i), F.lit(0))), 2, "0"),
    )
    table = bytearray(size)
    for at, text in values.groupBy(row.alias("row")).agg(F.array_join(digits, "")).collect():
        table[256 * at : 256 * at + 256] = bytes.fromhex(text)
    return bytes(table)


def size_classes(docs: DataFrame) -> bytes:
    """For each bucket of words, twice the logarithm of its count."""
    words = docs.select(F.explode(_words(F.col("text").cast("string"))).alias("word"))
    bucket = F.pmod(_hash(F.col("word")), F.lit(BUCKETS)).alias("id")
    size = F.least(F.floor(2 * F.log2(F.count(F.lit(1)).cast("double"))), F.lit(127))
    return _as_table(words.groupBy(bucket).agg(size.cast("int").alias("value")), BUCKETS)


def keys(line: Column, classes: bytes) -> Column:
    """The distinct words of a line as numbers, from rare to frequent."""

    def key(h: Column) -> Column:
        size = _byte(classes, F.pmod(h, F.lit(BUCKETS)))
        low = h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
        return F.shiftleft(size.cast("long"), _HASH_BITS).bitwiseOR(low)

    return F.sort_array(F.array_distinct(F.transform(F.transform(_words(line), _hash), key)))


def _sketch(keys: Column) -> Column:
    """Words that two sets do not share change at most one bit each."""

    def flip(bits: Column, key: Column) -> Column:
        spot = key.bitwiseAND(F.lit(63)).cast("int")
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), spot))

    return F.aggregate(keys, F.lit(0).cast("long"), flip)


def _wide_parts(keys: Column) -> Column:
    """As `_sketch`, in 2, 4 or 8 longs but for the last one, for sets of more words; else empty."""
    longs = F.lit(SKETCH_LONGS)
    for width in (SKETCH_LONGS // 2, SKETCH_LONGS // 4):
        longs = F.when(F.size(keys) <= width * SKETCH_WORDS, F.lit(width)).otherwise(longs)

    def part(number: Column) -> Column:
        return _sketch(F.filter(keys, lambda k: F.call_function("shiftright", k, F.lit(6)).bitwiseAND(longs - 1) == number))

    parts = F.transform(F.sequence(F.lit(0), longs - 2), part)
    return F.when(F.size(keys) > SKETCH_WORDS, parts).otherwise(F.array().cast("array<long>"))


def _wide_sketch(parts: Column, sketch: Column) -> Column:
    """``parts`` and the last long: all longs, flipped by each other, are the sketch of 64 bits.

    So is either half of a wide sketch, flipped by the other, the sketch of half the width.
    """
    last = F.aggregate(parts, sketch, lambda bits, part: bits.bitwiseXOR(part))
    return F.when(F.size(parts) > 0, F.concat(parts, F.array(last))).otherwise(parts)


def line_sets(docs: DataFrame) -> DataFrame:
    """Each set of words once: (doc_id, place) of its first line, size n, sketches, prefix keys."""
    classes = size_classes(docs)
    keyed = lines(docs).select("doc_id", "place", keys(F.col("line"), classes).alias("keys"))
    keyed = keyed.select("*", _sketch(F.col("keys")).alias("sketch"), _wide_parts(F.col("keys")).alias("parts"))
    n = F.size("keys")
    prefix = n - F.ceil(F.lit(NUM) * n / F.lit(DEN)).cast("int") + 1
    marked = keyed.select(
        F.xxhash64("keys").alias("id"),
        F.xxhash64("keys", F.lit(1)).alias("id2"),
        F.struct("doc_id", "place").alias("at"),
        n.alias("n"),
        "sketch",
        _wide_sketch(F.col("parts"), F.col("sketch")).alias("wide"),
        F.slice("keys", 1, prefix).alias("prefix"),
    )
    first = marked.groupBy("id", "id2").agg(
        F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("n", "sketch", "wide", "prefix")]
    )
    return stored(first.select("at.doc_id", "at.place", "n", "sketch", "wide", "prefix"), "line-sets")


def _earlier(a: str, b: str) -> Column:
    left, right = (F.struct(F.col(f"{s}_doc").alias("d"), F.col(f"{s}_place").alias("p")) for s in (a, b))
    return left < right


def _sets_fit(a: str, b: str) -> Column:
    """Length filter, and sketches that differ in as few bits as the sets may in words."""
    a_n, b_n = F.col(f"{a}_n"), F.col(f"{b}_n")
    sizes = F.lit(DEN) * F.least(a_n, b_n) >= F.lit(NUM) * F.greatest(a_n, b_n)
    bits = F.bit_count(F.col(f"{a}_sketch").bitwiseXOR(F.col(f"{b}_sketch")))
    return sizes & (F.lit(NUM + DEN) * bits <= F.lit(DEN - NUM) * (a_n + b_n))


def _wide_fit(a: str, b: str) -> Column:
    """Wide sketches that differ in few bits, of sets whose sizes fit; the wider one is halved."""
    a_wide, b_wide = F.col(f"{a}_wide"), F.col(f"{b}_wide")
    longs = F.least(F.size(a_wide), F.size(b_wide))

    def cut(wide: Column) -> Column:
        halves = F.slice(wide, F.lit(1), longs), F.slice(wide, longs + 1, longs)
        halved = F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(wide) > longs, halved).otherwise(wide)

    apart = F.zip_with(cut(a_wide), cut(b_wide), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    fits = F.lit(NUM + DEN) * bits <= F.lit(DEN - NUM) * (F.col(f"{a}_n") + F.col(f"{b}_n"))
    return F.when(longs > 0, fits).otherwise(F.lit(True))


def _places_fit(a: str, b: str) -> Column:
    """Positional filter for the first shared word; ``left`` is the words from it on."""
    a_n, b_n = F.col(f"{a}_n"), F.col(f"{b}_n")
    left = F.least(F.col(f"{a}_left"), F.col(f"{b}_left"))
    return F.lit(NUM + DEN) * left >= F.lit(NUM) * (a_n + b_n)


def _postings(sets: DataFrame, side: str, chosen: Column, *keep: str) -> DataFrame:
    """key, and the set's doc, place, n, sketch and left, for the keys ``chosen``."""
    rows = sets.select(
        "doc_id", "place", "n", "sketch", *keep, F.posexplode(chosen).alias("pos", "key")
    )
    return rows.select(
        "key",
        F.col("doc_id").alias(f"{side}_doc"),
        F.col("place").alias(f"{side}_place"),
        F.col("n").alias(f"{side}_n"),
        F.col("sketch").alias(f"{side}_sketch"),
        (F.col("n") - F.col("pos")).alias(f"{side}_left"),
        *[F.col(c).alias(f"{side}_{c}") for c in keep],
    )


_PAIR = ("x_doc", "x_place", "y_doc", "y_place")


def _spot() -> Column:
    return F.pmod(F.xxhash64("doc_id", "place"), F.lit(7 * FILTER_BYTES))


def _bits(refs: DataFrame) -> bytes:
    """A Bloom filter of (doc_id, place), seven bits a byte."""
    spot = refs.select(_spot().alias("spot"))
    byte = F.call_function("div", "spot", F.lit(7)).alias("id")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("spot") % 7).cast("int")))
    return _as_table(spot.groupBy(byte).agg(bits.alias("value")), FILTER_BYTES)


def _maybe(bits: bytes) -> Column:
    """Whether (doc_id, place) may be among those of ``bits``; never wrong if it says no."""
    byte = _byte(bits, F.call_function("div", _spot(), F.lit(7)))
    return F.call_function("shiftright", byte, (_spot() % 7).cast("int")).bitwiseAND(1) == 1


def _refs(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(F.col(f"{side}_doc").alias("doc_id"), F.col(f"{side}_place").alias("place"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, place) of each x whose words are similar enough to those of its y."""
    both = _refs(pairs, "x").unionByName(_refs(pairs, "y"))
    asked = lines(docs).filter(_maybe(_bits(both)))

    # Lines are shuffled as they are, which takes less than half of what their hashes take.
    # Rows that repeat a document have the same lines: they repeat pairs, no more.
    def of(side: str) -> DataFrame:
        return asked.select(
            F.col("doc_id").alias(f"{side}_doc"),
            F.col("place").alias(f"{side}_place"),
            F.col("line").alias(f"{side}_line"),
        )

    joined = pairs.join(of("x"), ["x_doc", "x_place"]).join(of("y"), ["y_doc", "y_place"])
    x_words, y_words = (
        F.array_distinct(F.transform(_words(F.col(f"{side}_line")), _hash)) for side in ("x", "y")
    )
    shared = F.size(F.array_intersect(x_words, y_words))
    sizes = F.size(x_words) + F.size(y_words)
    alike = joined.filter(F.lit(NUM + DEN) * shared >= F.lit(NUM) * sizes)
    return _refs(alike, "x").distinct()


def _first_looks(sets: DataFrame) -> DataFrame:
    """Pairs of a set and the earliest one of its size class under a key of its prefix's last half.

    Their shared word need not be the first one, so its place says nothing here. A much shorter
    or longer set could only hide those that fit; similar sets of two classes meet later.
    """
    half = F.call_function("div", F.size("prefix"), F.lit(2)).cast("int")
    skip = F.greatest(F.least(half, F.size("prefix") - FIRST_LOOK), F.lit(0))
    looks = _postings(sets, "x", F.slice("prefix", skip + 1, F.size("prefix")), "wide")
    looks = looks.drop("x_left")
    size = F.floor(4 * F.log2(F.col("x_n").cast("double")))
    looks = looks.withColumn("key", F.xxhash64("key", size))
    columns = ("doc", "place", "n", "sketch", "wide")
    own = F.struct(*[f"x_{c}" for c in columns])
    groups = looks.groupBy("key").agg(F.min(own).alias("y"), F.count(F.lit(1)).alias("many"))
    groups = groups.filter("many > 1").select(
        "key", *[F.col(f"y.x_{c}").alias(f"y_{c}") for c in columns]
    )
    fits = _earlier("y", "x") & _sets_fit("x", "y") & _wide_fit("x", "y")
    return looks.join(groups, (looks.key == groups.key) & fits).select(*_PAIR).distinct()


def _candidates(sets: DataFrame) -> DataFrame:
    """Pairs of a set that still ``asks`` and any earlier one that passes all filters.

    ``shared``: under how many keys they met. The side ``a`` is the larger set, of equal ones the later.
    """
    n = F.col("n")
    index = n - F.ceil(F.lit(2 * NUM) * n / F.lit(NUM + DEN)).cast("int") + 1
    a = _postings(sets, "a", F.col("prefix"), "asks", "wide")
    b = _postings(sets, "b", F.slice("prefix", 1, index), "asks", "wide")
    a_later = _earlier("b", "a")
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & a_later)
    asks = F.when(a_later, F.col("a_asks")).otherwise(F.col("b_asks"))
    apart = a_later | _earlier("a", "b")
    fits = larger & apart & asks & _sets_fit("a", "b") & _places_fit("a", "b") & _wide_fit("a", "b")
    later = {
        f"x_{c}": F.when(a_later, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("doc", "place")
    }
    earlier = {
        f"y_{c}": F.when(a_later, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")) for c in ("doc", "place")
    }
    met = None
    for number in range(SLICES):
        mine = F.pmod("key", F.lit(SLICES)) == number
        own_a, own_b = a.filter(mine), b.filter(mine)
        pairs = own_a.join(own_b, (own_a.key == own_b.key) & fits)
        named = pairs.select(*[v.alias(c) for c, v in (later | earlier).items()])
        counted = named.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("shared"))
        part = stored(counted, "candidates")
        met = part if met is None else met.unionByName(part)
    return met.groupBy(*_PAIR).agg(F.sum("shared").alias("shared"))


def similar_later_sets(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, place) of each set that an earlier one is similar to."""
    gone = stored(_verified(stored(_first_looks(sets), "looks"), docs), "gone")
    # Most sets cannot be among those; only the others are compared with them.
    maybe = _maybe(_bits(gone))
    found = gone.withColumn("asks", F.lit(False))
    some = sets.filter(maybe).join(found, ["doc_id", "place"], "left").fillna(True, ["asks"])
    marked = sets.filter(~maybe).withColumn("asks", F.lit(True)).unionByName(some)
    marked = stored(marked, "marked")  # every slice reads it
    pairs = stored(_candidates(marked), "candidates")
    # One pair for each set decides most; only sets that it leaves verify all of theirs.
    best = pairs.groupBy("x_doc", "x_place").agg(
        F.max(F.struct("shared", "y_doc", "y_place")).alias("y")
    )
    best = best.select("x_doc", "x_place", "y.y_doc", "y.y_place")
    by_best = stored(_verified(best, docs), "gone")
    done = by_best.select(F.col("doc_id").alias("x_doc"), F.col("place").alias("x_place"))
    rest = stored(pairs.join(done, ["x_doc", "x_place"], "left_anti").select(*_PAIR), "rest")
    return gone.unionByName(by_best).unionByName(_verified(rest, docs))


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place) of the lines with words that stay."""
    sets = line_sets(docs)
    later = stored(similar_later_sets(sets, docs), "later")
    return sets.select("doc_id", "place").join(later, ["doc_id", "place"], "left_anti")


def _per_document(places: DataFrame) -> DataFrame:
    """One row per document: its id, its text's checksum, and the numbers of the lines."""
    number = F.col("place").bitwiseAND((1 << 31) - 1).cast("int")
    rows = places.select("doc_id", F.shiftright("place", 31).alias("crc"), number.alias("number"))
    return rows.groupBy("doc_id", "crc").agg(F.array_sort(F.collect_list("number")).alias("kept"))


def _with_kept(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` and ``ld_kept``, the numbers of kept lines, for each row of ``docs``."""
    kept = _per_document(kept_lines(docs)).select(
        F.col("doc_id").alias("ld_doc"), F.col("crc").alias("ld_crc"), F.col("kept").alias("ld_kept")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(*columns, key.alias("ld_id"), F.crc32(text).alias("ld_sum"))
    joined = rows.join(kept, (F.col("ld_id") == F.col("ld_doc")) & (F.col("ld_sum") == F.col("ld_crc")), "left")
    none = F.array().cast("array<int>")
    return joined.withColumn("ld_kept", F.coalesce("ld_kept", none)).drop("ld_id", "ld_sum", "ld_doc", "ld_crc")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later lines taken out of ``text``, and ``n_chars``, if there, set anew."""
    others = [c for c in docs.columns if c != "text"]
    rows = _with_kept(docs, [F.struct(*others).alias("doc"), F.col("text")])
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))

    def stays(part: Column) -> Column:
        return ~F.regexp_like(part["line"], F.lit(r"[^\x20\x09-\x0D]")) | F.array_contains(F.col("ld_kept"), part["i"])

    left = F.transform(F.filter(numbered, stays), lambda part: part["line"])
    rows = rows.select("doc", F.array_join(left, "\n").alias("text"))
    columns = {c: F.col("doc")[c] for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def line_decisions(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: its lines with words, how many stay, and which (from 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_words = F.regexp_count(text, F.lit(r"(?m)^[^\n]*[^\x20\x09-\x0D\n][^\n]*$"))
    rows = _with_kept(docs, [F.col("doc_id"), with_words.cast("long").alias("n_lines")])
    return rows.select(
        "doc_id",
        "n_lines",
        F.size("ld_kept").cast("long").alias("n_kept"),
        F.array_join(F.col("ld_kept").cast("array<string>"), ",").alias("kept_lines"),
    )
