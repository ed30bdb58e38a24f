"""Quality rules: text statistics and a learned decision list.

``text_stats`` gives statistics of whole texts, all within a row. ``learn`` grows and prunes
threshold conjunctions for low quality by sequential covering on a bounded sample of
labelled rows. ``verdict`` emits the ordered list as one Spark conditional expression.

Edge cases: null or empty text has no words and zero statistics; it fails the base rule.
Repeated rows are judged one by one. Without labels of both classes the list is empty and
only the base rule rejects. Labels of unknown documents are ignored; a document with several
labels counts as good if any says so. All columns of documents travel in one struct, so their
names cannot clash.
Five-word windows are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SPACE, space_words

SPAN = 5
#: At most so many labelled rows are fitted on, those with the smallest hash of doc_id.
FIT_ROWS = 4000
#: Statistics of a text that conditions may test.
FEATURES = (
    "mean_word",
    "symbol_rate",
    "dup_line_rate",
    "repeat_rate",
    "upper_rate",
    "mark_rate",
    "digit_rate",
    "line_words",
    "n_words",
)


def repeated_words(words: Column, n: Column) -> tuple[Column, Column, Column]:
    """Expressions, each over the one before: window hashes, sorted windows, covered words.

    They are to be bound to the columns ``windows``, ``ordered`` and the count.
    """
    hashes = F.when(
        n >= SPAN,
        F.transform(
            F.sequence(F.lit(0), n - SPAN),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SPAN)]),
        ),
    )
    windows, ordered = F.col("windows"), F.col("ordered")
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    by_hash = F.when(
        again,
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    )
    same = lambda s, k: F.coalesce(s["h"] == F.get(ordered, k)["h"], F.lit(False))
    starts = F.array_sort(
        F.transform(
            F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["at"]
        )
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n")
        ),
    )["n"]
    return hashes, by_hash, F.coalesce(covered, F.lit(0)).cast("long")


def text_stats(documents: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and rates).

    ``row`` is a struct of all columns of ``documents``, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda kinds: F.length(F.regexp_replace(text, kinds, "")).cast("long")
    size = F.length(text).cast("long")
    hashes, by_hash, covered = repeated_words(F.col("words"), F.col("n"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (
        documents.select(F.struct("*").alias("row"), "text")
        .select("row", "text", space_words(F.col("text")).alias("words"), lines.alias("lines"))
        .select(
            "row",
            "words",
            F.size("words").alias("n"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            without(SPACE).alias("word_chars"),
            (size - without("[#*$%&|<>]+")).alias("n_symbols"),
            (size - without("[A-Z]+")).alias("n_upper"),
            (size - without("[!?]+")).alias("n_marks"),
            (size - without("[0-9]+")).alias("n_digits"),
        )
        .select("*", hashes.alias("windows"))
        .select("*", by_hash.alias("ordered"))
        .select("*", F.col("n").cast("long").alias("n_words"), covered.alias("n_repeat_words"))
        .drop("n", "words", "windows", "ordered")
        .select(
            "*",
            rate("word_chars", "n_words").alias("mean_word"),
            rate("n_symbols", "n_words").alias("symbol_rate"),
            rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
            rate("n_repeat_words", "n_words").alias("repeat_rate"),
            rate("n_upper", "word_chars").alias("upper_rate"),
            rate("n_marks", "n_words").alias("mark_rate"),
            rate("n_digits", "word_chars").alias("digit_rate"),
            rate("n_words", "n_lines").alias("line_words"),
        )
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def holds(self, value: float) -> bool:
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _conditions(rows: list[dict], steps: int = 24) -> list[Condition]:
    """Thresholds halfway between neighbouring values at the features' quantiles."""
    out = []
    for feature in FEATURES:
        values = sorted(float(r[feature]) for r in rows)
        cuts = set()
        for k in range(1, steps):
            i = k * len(values) // steps
            j = i
            while j < len(values) and values[j] == values[i]:
                j += 1
            if j < len(values):
                cuts.add((values[i] + values[j]) / 2)
        out += [Condition(feature, above, cut) for cut in sorted(cuts) for above in (True, False)]
    return out


def covering(rows: list[dict], precision: float = 0.9, least: int = 8, longest: int = 3) -> list[Rule]:
    """Rules for ``bad`` rows, best first, by growing on two thirds and pruning on the rest.

    Sets of rows are bits of integers. A rule is kept if at least ``precision`` of what it
    covers among all remaining rows is bad, and it covers ``least`` of them.
    """
    conditions = _conditions(rows)
    bits = lambda f: sum(1 << i for i, r in enumerate(rows) if f(i, r))
    masks = {c: bits(lambda _, r, c=c: c.holds(float(r[c.feature]))) for c in conditions}
    bad = bits(lambda _, r: r["bad"])
    grow = bits(lambda i, _: i % 3 != 2)
    left = (1 << len(rows)) - 1
    rules: list[Rule] = []

    def share(mask: int) -> float:
        n = mask.bit_count()
        return ((mask & bad).bit_count() + 0.5) / (n + 1.0) if n else 0.0

    def covered(rule: Rule, within: int) -> int:
        for c in rule:
            within &= masks[c]
        return within

    while (bad & left).bit_count() >= least:
        rule: Rule = ()
        now = left & grow
        while len(rule) < longest and now & ~bad:
            best = max(
                conditions,
                key=lambda c: (now & masks[c] & bad).bit_count() ** 0.5 * (share(now & masks[c]) - share(now)),
            )
            if share(now & masks[best]) <= share(now):
                break
            rule, now = (*rule, best), now & masks[best]
        held = left & ~grow
        while len(rule) > 1 and share(covered(rule[:-1], held)) >= share(covered(rule, held)):
            rule = rule[:-1]
        mask = covered(rule, left)
        n = mask.bit_count()
        if not rule or (mask & bad).bit_count() < least or (mask & bad).bit_count() < precision * n:
            break
        rules.append(rule)
        left &= ~mask
    return rules


def learn(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> list[Rule]:
    """The decision list learned from at most ``bound`` labelled documents."""
    order = F.xxhash64("doc_id")
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label_quality"))
        .orderBy(order, "doc_id")
        .limit(bound)
    )
    known = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = text_stats(known).select("row.label_quality", *FEATURES).collect()
    rows = sorted(
        ({f: r[f] for f in FEATURES} | {"bad": r.label_quality == 0} for r in found),
        key=lambda r: tuple(r[f] for f in FEATURES),
    )
    if len({r["bad"] for r in rows}) < 2:
        return []
    return covering(rows)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: false by the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, statistics, base_failed, kept) per row of ``documents``."""
    return (
        text_stats(documents)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )
