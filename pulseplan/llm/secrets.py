"""Scans for secrets, by a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression. Its Boolean trigram query says which trigrams a text
must hold (`trigrams`). The index lists, for every trigram that some rule asks for, the
documents that hold it in any case of letters. The rules' queries are answered on these
postings, and only the documents found are searched with the expression. A rule without
mandatory trigrams, like that of hexadecimal runs, searches every document.

A trigram in a third of all documents is no hot key: postings are counted per document,
beginning in the task that wrote them, and no list of documents is ever gathered.

Positions are code points. Nulls: a null text is empty and holds no secret; a null
document id is a value like any other. Repeated ids and rows are searched each on their
own. An empty table gives no rows. Columns that a document brings keep their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


# --- fixed values: what is looked for. A run of 24 or more hexadecimal digits, or of 16
# or more after AKIA, is the same span as a longest run that is long enough. ---
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        at_least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
# --- end of fixed values ---
RULES = BASE_RULES + MORE_RULES

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _lists(names: Sequence[str]) -> Column:
    return F.array(*map(F.lit, names))


def postings(docs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of ``wanted`` that a text holds."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, and the numbers of the rules whose trigram query its postings answer."""
    clauses = [
        (kind, sorted(clause))
        for kind, rule in enumerate(rules)
        for clause in sorted(trigram_query(rule.pattern), key=sorted)
    ]
    wanted = sorted({t for _, clause in clauses for t in clause})
    # What each trigram answers: (clause, its bit there). The rules are few and fixed.
    uses = {
        t: [F.struct(F.lit(c).alias("clause"), F.lit(1 << clause.index(t)).cast("long").alias("bit"))
            for c, (_, clause) in enumerate(clauses) if t in clause]
        for t in wanted
    }
    answers = F.lit(None).cast("array<struct<clause:int,bit:bigint>>")
    for t in wanted:
        answers = F.when(F.col("trigram") == t, F.array(*uses[t])).otherwise(answers)
    met = (
        postings(docs, wanted)
        .select("doc_id", F.explode(answers).alias("a"))
        .groupBy("doc_id", F.col("a.clause").alias("clause"))
        .agg(F.bit_or("a.bit").alias("bits"))
    )
    whole = F.element_at(F.array(*[F.lit((1 << len(c)) - 1).cast("long") for _, c in clauses]), F.col("clause") + 1)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in clauses]), F.col("clause") + 1)
    return (
        met.filter(F.col("bits") == whole)
        .groupBy("doc_id")
        .agg(F.collect_set(kind).alias("kinds"))
    )


def spans(text: Column, kind: int, rule: Rule) -> Column:
    """Where ``rule`` matches: array of (start, kind, end), end exclusive."""
    pattern = F.lit(rule.pattern)
    # The text between matches and the matches themselves, in turn, give all positions.
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast(_SPAN)

    def add(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        long_enough = F.coalesce(F.length(part["value"]) >= rule.at_least, F.lit(False))
        found = F.when(long_enough, F.concat(done["found"], F.array(span).cast(_SPAN)))
        return F.struct(
            end.cast("long").alias("at"), found.otherwise(done["found"]).alias("found")
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    return F.aggregate(parts, begin, add, lambda done: done["found"])


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``, in order of start and then of the rules, for each row."""
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = [k for k, r in enumerate(rules) if trigram_query(r.pattern) != ANY]
    found = candidates(whole, [rules[k] for k in asked]).withColumnRenamed("doc_id", "found_id")
    rows = whole.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    all_spans = []
    for k, rule in enumerate(rules):
        if k in asked:
            worth = F.array_contains("kinds", asked.index(k))
        else:
            worth = F.regexp_like(F.col("text"), F.lit(rule.pattern))
        none = F.array().cast(_SPAN)
        all_spans.append(F.when(worth, spans(F.col("text"), k, rule)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*all_spans)).alias("spans"))


def span_list(found: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = _lists([r.kind for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base rules' spans, their checksum, and all spans."""
    found = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{r.kind}")
        for k, r in enumerate(BASE_RULES)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base, RULES), 256).alias("base_sha256"),
        span_list(F.col("spans"), RULES).alias("spans"),
    )
