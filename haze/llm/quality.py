"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditions.

``text_statistics`` adds per-text counts with array and string functions alone (one row in, one row
out; work linear in the text).  ``learn_rules`` grows one conjunction of thresholds at a time on two
thirds of the labelled rows (best information gain per added condition), prunes it back on the
remaining third, keeps it if it is precise enough there, removes what it covers and starts again.  A
conjunction that fails is set aside and the next best starts are grown, ``AT_ONCE`` side by side; the list ends when no start is left
that covers ``MIN_COVER`` bad documents of the pruning third (fewer could not pass).  Each condition's cuts
are quantiles of the rows that the conjunction still covers, so they get finer as it grows.
Each grown condition is two aggregations that return one row and at most
``len(FEATURES) * BINS`` rows, whatever the number of labelled documents.  The result is an
ordered list of conjunctions; ``verdict`` renders it as one ``CASE WHEN`` over the statistics.

Defined cases: null or empty text has no words (and fails the base rule); without labels of both
kinds the list is empty and the base rule alone decides; several labels of a document count as bad
if any is; labels without a document and documents without a label take no part in learning; an empty table gives an
empty result; ``filtered`` carries other columns in a struct, whatever their names, ``rated`` returns the named keys only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haze.llm._sql import let
from haze.session import written

SPACE = r"[\x20\x09-\x0D]+"
#: ASCII that no statistic counts by kind, named one by one: such a class is a table, ranges and properties are tested in turn.
_PLAIN = "".join(f"\\x{i:02x}" for i in range(128) if not re.match(r"[#*$%&|<>!?0-9A-Z]", chr(i)))
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BINS = 32
AT_ONCE = 8  # conjunctions grown side by side
MIN_PRECISION, MIN_COVER = 0.9, 5

#: Statistics that rules may test; all are finite for any text.
FEATURES = {
    "f_words": "CAST(n_words AS DOUBLE)",
    "f_word_length": "word_chars / greatest(n_words, 1)",
    "f_symbols": "n_symbols / greatest(word_chars, 1)",
    "f_upper": "n_upper / greatest(word_chars, 1)",
    "f_marks": "n_marks / greatest(n_words, 1)",
    "f_digits": "n_digits / greatest(word_chars, 1)",
    "f_dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "f_repeat": "n_repeat_words / greatest(n_words, 1)",
    "f_distinct": "n_distinct_words / greatest(n_words, 1)",
}


def words_of(text: Column) -> Column:
    """The pieces between runs of ``SPACE``; every such character becomes a blank first, so that the cut needs no pattern."""
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a ``width``-word window that the text holds at least twice.

    Windows are compared by a 64-bit hash of their words' hashes.  Texts without a repeat leave after
    one distinct count; only the others sort their windows.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - F.lit(width)),
        lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(width)])))

    def covered(starts: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda i: F.least(
            F.lit(width), F.coalesce(F.get(starts, i) - F.get(starts, i - F.lit(1)), F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def slow(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ranked, lambda s: let(s["x"], lambda x: F.filter(s["i"], lambda _, k: F.get(x, k).eqNullSafe(
            F.get(x, k - F.lit(1))) | F.get(x, k).eqNullSafe(F.get(x, k + F.lit(1))))))
        return let(F.sort_array(twice), covered)

    fast = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
               .otherwise(slow(g)))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(fast)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one ``st`` struct of counts (a struct, so that no column of ``docs`` is shadowed)."""
    t = F.coalesce(F.col(text), F.lit(""))
    left = lambda s, pattern: F.char_length(F.regexp_replace(s, pattern, "")).cast("long")
    marked = F.regexp_replace(t, f"[{_PLAIN}]+", "")  # the counted kinds are a small part of a text: one pass over it for all
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return let(lines, lambda ln: let(marked, lambda m: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            left(m, r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            left(m, r"[^\p{Lu}]+").alias("n_upper"),
            left(m, r"[^!?]+").alias("n_marks"),
            left(m, r"[^0-9]+").alias("n_digits"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"))))

    return docs.withColumn("st", let(words_of(t), counts))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _cell(feature: str, cuts: list[float], base: int) -> str:
    """SQL for ``base`` plus the number of ``cuts`` (rising) below the feature, by halving: a few comparisons a row, compiled."""
    def part(low: int, high: int) -> str:
        if low == high:
            return str(base + low)
        mid = (low + high) // 2
        return f"CASE WHEN {feature} > {float(cuts[mid])!r}D THEN {part(mid + 1, high)} ELSE {part(low, mid)} END"

    return part(0, len(cuts))


def _sides(rows: DataFrame, bins: int) -> tuple[list[int], list[tuple[Condition, list[int]]]]:
    """Every condition on a quantile of ``rows`` with its counts: bad and good to grow on, bad and good to prune on.

    The first item holds the counts of all rows.
    """
    names = list(FEATURES)
    points = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in names]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in names}
    entry = F.expr(f"explode(array({', '.join(_cell(f, cuts[f], i * bins) for i, f in enumerate(names))}))").alias("cell")
    kind = (F.when(F.col("bad"), 0).otherwise(1) + F.when(F.col("prune"), 2).otherwise(0)).alias("kind")
    at: dict[tuple[int, int], list[int]] = {}
    for r in rows.select(kind, entry).groupBy("cell", "kind").count().collect():
        at.setdefault(divmod(r["cell"], bins), [0, 0, 0, 0])[r["kind"]] = r["count"]
    total = [sum(v[k] for (i, _), v in at.items() if i == 0) for k in range(4)]
    sides = []
    for i, f in enumerate(names):
        low = [0, 0, 0, 0]
        for c, cut in enumerate(cuts[f]):
            low = [a + b for a, b in zip(low, at.get((i, c), (0, 0, 0, 0)))]
            sides.append((Condition(f, False, cut), low))
            sides.append((Condition(f, True, cut), [a - b for a, b in zip(total, low)]))
    return total, sides


def _tightest(conditions: list[Condition]) -> Rule:
    """One condition for each statistic and direction: the last, as every cut lies inside the earlier ones."""
    return tuple({(c.feature, c.above): c for c in conditions}.values())


def _side(c: Condition) -> Column:
    return F.col(c.feature) > F.lit(c.cut) if c.above else F.col(c.feature) <= F.lit(c.cut)


def _starts(total: list[int], sides: list, min_cover: int) -> list[tuple[Condition, list[int]]]:
    """Conditions that gain and cover enough, the best first; of equal ones the earlier."""
    found = [(_gain(total[0], total[1], counts[0], counts[1]), condition, counts) for condition, counts in sides if counts[2] >= min_cover]
    return [(c, counts) for gain, c, counts in sorted(found, key=lambda x: -x[0]) if gain > 1e-9]


def _grown(rest: DataFrame, first: tuple, bins: int, min_cover: int) -> tuple[list[Condition], list[list[int]]]:
    """The conjunction grown from a first condition, and the counts after each condition."""
    (condition, counts), left = first, rest
    grown, trail = [condition], [counts]
    while counts[1]:
        left = left.where(_side(condition))
        best = _starts(*_sides(left, bins), min_cover)[:1]
        if not best:
            break
        condition, counts = best[0]
        grown.append(condition)
        trail.append(counts)
    return grown, trail


def learn_rules(rows: DataFrame, bins: int = BINS, min_precision: float = MIN_PRECISION,
                min_cover: int = MIN_COVER) -> list[Rule]:
    """Ordered reject rules from ``rows`` (the statistics, ``bad`` boolean, ``prune`` boolean)."""
    rest = written(rows.select(*[F.expr(e).alias(f) for f, e in FEATURES.items()], "bad", "prune"), "rule-rows")
    grow = inheritable_thread_target(rest.sparkSession)(_grown)
    rules: list[Rule] = []
    while True:
        starts, rule, at = _starts(*_sides(rest, bins), min_cover), None, 0
        while rule is None and at < len(starts):
            # starts do not depend on each other: once the best one failed, the next ones are grown side by side and taken in their order
            some = starts[at:at + (AT_ONCE if at else 1)]
            at += len(some)
            with ThreadPool(len(some)) as pool:
                found = pool.map(lambda first: grow(rest, first, bins, min_cover), some)
            for grown, trail in found:
                precise = [k for k, (_, _, p, n) in enumerate(trail) if p >= min_precision * (p + n)]
                if precise:
                    keep = max(precise, key=lambda k: (trail[k][2] - trail[k][3]) / (trail[k][2] + trail[k][3])) + 1
                    rule = _tightest(grown[:keep])
                    break
        if rule is None:
            return rules
        rules.append(rule)
        hit = F.lit(True)
        for c in rule:
            hit = hit & _side(c)
        rest = written(rest.where(~hit), "rule-rows")


def verdict(rules: list[Rule]) -> Column:
    """``keep``, or ``reject:<k>`` for the first rule of the list that fires."""
    out = F.when(base_failed(), F.lit("reject:base"))
    for k, rule in enumerate(rules):
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column()
        out = out.when(hit, F.lit(f"reject:{k}"))
    return out.otherwise(F.lit("keep"))


def labelled(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Statistics of the labelled documents that pass the base rule, with ``bad`` and ``prune``."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(
        (F.min("quality") == 0).alias("bad"))
    third = F.pmod(F.xxhash64(F.col("_label_id"), F.lit(1)), F.lit(3)) == 0
    return stats.join(marks, F.col(doc_id) == F.col("_label_id")).select("st.*", "bad", third.alias("prune")).where(
        ~base_failed())


def rated(docs: DataFrame, labels: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``keys``, the statistics and ``verdict`` of every document, and the learned list.

    The statistics are computed once and written; learning and rating reread them.
    """
    stats = written(text_statistics(docs.select(*dict.fromkeys([*keys, text])), text).select(*keys, "st"), "quality")
    rules = learn_rules(labelled(stats, labels))
    return stats.select(*keys, "st.*").withColumn("verdict", verdict(rules)), rules


def filtered(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without those that the base rule or the learned list rejects.

    Rows and statistics are computed once and written; learning and filtering reread them.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_t"))
    stats = written(text_statistics(inner, "_t").select("row", "st"), "quality")
    rules = learn_rules(labelled(stats.select(F.col(f"row.`{doc_id}`").alias("_doc_id"), "st"), labels, "_doc_id"))
    return stats.select("row", "st.*").where(verdict(rules) == "keep").select("row.*")
