"""URL filter: host/path rules first, a character language-model ratio for the rest.

URLs that a rule decides are the labelled corpus.  The models read whole URLs, scheme, query and fragment
too (the host lower-cased); host and path alone serve the rules.  Two variable-order Markov models, one for allowed
and one for blocked URLs, are estimated from all of them: character counts for every context of 0 to
``ORDER`` characters, smoothed by Witten-Bell interpolation from the longest seen context down to a
uniform distribution.  A URL scores the mean over its characters of ``ln(P_allow / P_block)``.  The
threshold is calibrated on URLs that a second pair of models, counted without them, never saw.

Everything is joins and aggregations: one table of distinct character windows holds the counts and,
after ``ORDER + 1`` small joins, the log ratios; it is never collected or forced into a broadcast.
Equal URLs are scored once with a weight, so a repeated URL is one row.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; a null URL
has no score and gets ``default``, any other is scored; with an empty class there is no model and every
undecided URL gets ``default``.  Repeated rows give repeated results; an empty table gives an empty result.  Columns named host, path,
rule, verdict or score are replaced by the results; other columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haze.llm._sql import LOWER, UPPER, let
from haze.session import written

ORDER = 4            # longest context, in characters
UNIFORM = 1.0 / 256  # probability of a character that no context has seen
FOLDS = 5            # one of them calibrates
BINS_PER_UNIT, BIN_LIMIT = 50, 1000  # calibration histogram: at most 2 * BIN_LIMIT + 1 bins
PAD, END = "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains below ``path`` (which starts with a slash)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def modelled(url: Column, host: Column) -> Column:
    """The whole URL with its host as in ``host``; as it is without ``://``, null for null."""
    start = F.instr(url, "://") + F.lit(2)
    return F.when(F.contains(url, F.lit("://")), F.concat(
        F.substr(url, F.lit(1), start), host, F.substr(url, start + F.char_length(host) + F.lit(1)))).otherwise(url)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def windows(text: Column, order: int = ORDER) -> Column:
    """Every character of ``text`` and its end mark, each with the ``order`` characters before it."""
    chars = F.split(F.concat(F.lit(PAD * order), text, F.lit(END)), "")
    return let(chars, lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - F.lit(order + 1)),
        lambda i: F.concat(*[F.get(c, i + F.lit(k)) for k in range(order + 1)])))


def _smoothed(counts: DataFrame, names: list[str], order: int) -> DataFrame:
    """Probabilities ``p_<name>`` of each window's last character under each column of counts."""
    known = None
    for k in range(order + 1):
        level = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(
            *[F.sum(n).alias(n) for n in names])
        context = Window.partitionBy("ctx")
        level = level.withColumn("ctx", F.expr(f"left(gram, {k})")).select(
            "gram", *names, *[F.sum(n).over(context).alias(f"n_{n}") for n in names],
            *[F.sum((F.col(n) > 0).cast("long")).over(context).alias(f"u_{n}") for n in names])
        if known is None:
            level = level.select("*", *[F.lit(UNIFORM).alias(f"q_{n}") for n in names])
        else:
            shorter = known.select(F.col("gram").alias("tail"), *[F.col(f"p_{n}").alias(f"q_{n}") for n in names])
            level = level.join(shorter, F.expr(f"right(gram, {k})") == F.col("tail")).drop("tail")
        known = level.select("gram", *[
            F.when(F.col(f"n_{n}") > 0, (F.col(n) + F.col(f"u_{n}") * F.col(f"q_{n}"))
                   / (F.col(f"n_{n}") + F.col(f"u_{n}"))).otherwise(F.col(f"q_{n}")).alias(f"p_{n}")
            for n in names])
    return known


def language_scores(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``texts`` (s, label allow/block/null, n) with ``score`` and ``held_score``.

    ``score`` uses the models of all labelled texts, ``held_score`` those counted without the texts'
    calibration fold (``held`` marks that fold).
    """
    held = F.pmod(F.xxhash64(F.col("s"), F.lit(42)), F.lit(FOLDS)) == 0
    rows = texts.select("s", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(7), F.reverse("s")).alias("k2"),
                        "label", "n", held.alias("held"))
    cells = rows.select("k1", "k2", "label", "n", "held", F.explode(windows(F.col("s"), order)).alias("gram"))
    is_a, is_b = F.col("label").eqNullSafe("allow"), F.col("label").eqNullSafe("block")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    names = ["a", "b", "fa", "fb"]
    counts = cells.groupBy("gram").agg(count(is_a).alias("a"), count(is_b).alias("b"),
                                       count(is_a & ~F.col("held")).alias("fa"),
                                       count(is_b & ~F.col("held")).alias("fb"))
    ratio = _smoothed(counts, names, order).select(
        F.col("gram").alias("g"), F.ln(F.col("p_a") / F.col("p_b")).alias("r"),
        F.ln(F.col("p_fa") / F.col("p_fb")).alias("fr"))
    scored = cells.select("k1", "k2", "gram").join(ratio, F.col("gram") == F.col("g")).groupBy("k1", "k2").agg(
        F.avg("r").alias("score"), F.avg("fr").alias("held_score"))
    return rows.join(scored, ["k1", "k2"])


def calibrated(scores: DataFrame) -> float | None:
    """The cut on ``held_score`` with the best balanced accuracy over the calibration fold.

    The table that reaches the driver is a histogram of at most ``2 * BIN_LIMIT + 1`` bins.  Null when
    either class has no held-out text.
    """
    cell = F.greatest(F.lit(-BIN_LIMIT), F.least(F.lit(BIN_LIMIT), F.floor(F.col("held_score") * BINS_PER_UNIT)))
    found = scores.where(F.col("held") & F.col("label").isNotNull()).groupBy(cell.cast("int").alias("cell")).agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b")).collect()
    n_a, n_b = sum(r["a"] for r in found), sum(r["b"] for r in found)
    if not n_a or not n_b:
        return None
    best = None
    below_a = below_b = 0
    low = -BIN_LIMIT
    for cell, a, b in sorted((r["cell"], r["a"], r["b"]) for r in found) + [(BIN_LIMIT + 1, 0, 0)]:
        cut = min(max(0, low), cell)  # every cut from low to cell splits alike: the one nearest to 0
        best = min(best or (math.inf,), (-((n_a - below_a) / n_a + below_b / n_b), abs(cut), cut))
        below_a, below_b, low = below_a + a, below_b + b, cell + 1
    return best[2] / BINS_PER_UNIT


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
          order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null where a rule or the default decides)."""
    host, path = host_path(F.col(url))
    parts = pages.withColumns({"host": host, "path": path, "_text": modelled(F.col(url), host)})
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": name, "verdict": verdict})
    text = F.col("_text")
    texts = parts.where(text.isNotNull()).groupBy(text.alias("s")).agg(
        F.first("verdict").alias("label"), F.count(F.lit(1)).alias("n"))
    scores = written(language_scores(texts, order), "url-scores")
    labelled = {r["label"] for r in scores.where(F.col("label").isNotNull()).select("label").distinct().collect()}
    cut = calibrated(scores)
    cut = 0.0 if cut is None else cut
    known = scores.where(F.col("label").isNull()).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"),
                                                         F.col("score").alias("score"))
    joined = parts.drop("score").join(known, (F.xxhash64(text) == F.col("_k1"))
                                      & (F.xxhash64(F.lit(7), F.reverse(text)) == F.col("_k2")), "left")
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block") if labelled >= {"allow", "block"} \
        else F.lit(default)
    method = F.when(F.col("score").isNull(), F.lit(default)).otherwise(by_model)
    return joined.drop("_k1", "_k2", "_text").withColumn("verdict", F.coalesce("verdict", method))
