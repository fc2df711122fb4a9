"""Deterministic splits and folds with exact sizes, without a global sort.

Rows are ordered by a seeded hash of their key: ``md5(key || '-' || seed)``
(hex, so string order is numeric order), rows with equal keys by a hash of the whole row.
A split cuts that order into consecutive chunks of exact sizes (hold-out:
``ceil(frac·n)`` test rows first; k-fold: sizes ``n//k + 1`` for the first
``n % k`` folds, then ``n//k``), optionally per stratum.

A row-number window over the whole table would send every row to one task.
Instead the cut points are found by **radix selection** on the hash:

1. one aggregation gives the row count of each stratum;
2. the cut ranks are computed on the driver (a handful of numbers);
3. for each cut, rows sharing the cut's known hash prefix are counted per
   next ``DIGITS`` hex digits — a partial aggregation whose output is at
   most ``16**DIGITS`` rows per cut — and the bucket holding the wanted rank
   extends the prefix;
4. once a bucket holds at most ``leaf_rows`` rows, those few hashes are fetched and ranked exactly
   on the driver; a bucket of equal keys is split further by a hash of the whole row.

Every step scans in parallel; what reaches the driver per level is bounded (about a million prefix
counts and two million hashes, whatever the number of cuts: the leaf size and the digits per level
shrink as cuts grow).  The cuts then go back as literals or as a small broadcast table (one row per
stratum), and each row's chunk is the number of cuts at or below its own hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haze.session import written

DIGITS = 3
HASH_LEN = 32
TIE_LEN = 16                  # hex digits of the row hash that orders rows with equal keys
LITERAL_STRATA = 64           # up to this many open prefixes or strata become literals, more a joined table
FETCH_BUDGET = 2_000_000      # keys fetched to the driver per selection level, over all cuts
COUNT_BUDGET = 1_100_000      # prefix counts returned to the driver per selection level


def order_hash(key_cols: list[str], seed: int = 42) -> Column:
    """md5 hex of the key text and the seed; a single key is written as ``cast(key as string)``, null as empty."""
    if len(key_cols) == 1:
        text = F.coalesce(F.col(f"`{key_cols[0]}`").cast("string"), F.lit(""))
    else:
        text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key_cols])
    return F.md5(F.concat(text, F.lit(f"-{seed}")))


def _row_hash(df: DataFrame, seed: int) -> Column:
    """16 hex digits of the whole row: orders rows whose keys are equal."""
    parts = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(F.col(f"`{f.name}`"))
             for f in df.schema.fields]
    return F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), TIE_LEN, "0"))


def kfold_sizes(n: int, k: int) -> list[int]:
    q, r = divmod(n, k)
    return [q + 1] * r + [q] * (k - r)


def holdout_sizes(n: int, frac: float) -> list[int]:
    t = min(n, math.ceil(frac * n))
    return [t, n - t]


def _cut_ranks(sizes: list[int]) -> list[int]:
    """Start rank of every chunk after the first (a rank equal to n needs no cut)."""
    out, acc = [], 0
    n = sum(sizes)
    for s in sizes[:-1]:
        acc += s
        if acc < n:
            out.append(acc)
    return out


def assign_chunks(df: DataFrame, key_cols: list[str], sizes_for, strata: list[str] | None = None,
                  seed: int = 42, out: str = "chunk", leaf_rows: int = 50_000) -> DataFrame:
    """Add ``out`` = index of the consecutive chunk each row falls in.

    ``sizes_for(n)`` gives the chunk sizes of a stratum with ``n`` rows.  Rows are split, not keys: rows
    with one key are ordered by a hash of the whole row, and if a cut falls among rows that are equal
    throughout, the table is written once with a number per row that settles them.
    """
    strata = list(strata or [])
    order = F.concat(order_hash(key_cols, seed), _row_hash(df, seed))
    hashed = df.withColumn("_h", order)
    cuts = _cuts(hashed, strata, sizes_for, leaf_rows, HASH_LEN + TIE_LEN)
    if cuts is None:
        numbered = written(df.withColumn("_copy", F.monotonically_increasing_id()), "split")
        hashed = numbered.withColumn("_h", F.concat(order, F.md5(F.col("_copy").cast("string")))).drop("_copy")
        cuts = _cuts(hashed, strata, sizes_for, leaf_rows, 2 * HASH_LEN + TIE_LEN)
    return _apply_cuts(hashed, strata, cuts, out).drop("_h")


def _cuts(hashed: DataFrame, strata: list[str], sizes_for, leaf_rows: int, length: int) -> dict | None:
    """(stratum, cut) -> hash of the first row after the cut; None if a cut falls among equal hashes."""
    sizes = _stratum_sizes(hashed, strata)
    targets = [(g, j, r) for g, n in sizes.items() for j, r in enumerate(_cut_ranks(sizes_for(n)))]
    # bound the driver traffic however many cuts there are: fewer keys per leaf when cuts are many
    leaf_rows = min(leaf_rows, max(64, FETCH_BUDGET // max(1, len(targets))))
    return _radix_select(hashed, strata, targets, leaf_rows, sizes, length)


def _stratum_sizes(df: DataFrame, strata: list[str]) -> dict[tuple, int]:
    rows = df.groupBy(*strata).count().collect() if strata else [df.agg(F.count(F.lit(1)).alias("count")).first()]
    return {tuple(r[c] for c in strata): r["count"] for r in rows}


def _stratum_match(strata: list[str], values: tuple) -> Column:
    cond = F.lit(True)
    for c, v in zip(strata, values):
        cond = cond & (F.col(c).isNull() if v is None else (F.col(c) == F.lit(v)))
    return cond


def _table(df: DataFrame, strata: list[str], rows: list[tuple], extra: str) -> tuple[DataFrame, Column]:
    """A broadcast table (one row per open prefix or stratum) and its null-safe join condition on the strata."""
    kinds = ", ".join([f"_s{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(strata)] + [extra])
    table = F.broadcast(df.sparkSession.createDataFrame(rows, kinds))
    cond = F.lit(True)
    for i, c in enumerate(strata):
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"_s{i}"))
    return table, cond


def _under(df: DataFrame, strata: list[str], prefixes: set[tuple[tuple, str]]) -> DataFrame:
    """Rows under any of the (stratum, hash prefix) pairs, with their prefix ``_pre``."""
    length = {len(p) for _, p in prefixes}.pop()
    head = F.substring("_h", 1, length) if length else F.lit("")
    if len(prefixes) <= LITERAL_STRATA:
        cond = F.lit(False)
        for g, p in prefixes:
            cond = cond | (_stratum_match(strata, g) & (head == F.lit(p)))
        return df.where(cond).withColumn("_pre", head)
    table, same = _table(df, strata, [(*g, p) for g, p in prefixes], "_pre string")
    return df.join(table, same & (head == F.col("_pre")))


def _radix_select(df: DataFrame, strata: list[str], targets, leaf_rows: int, sizes: dict, length: int):
    """The hash at each target rank, found level by level on hash prefixes."""
    state = {(g, j): ["", r] for g, j, r in targets}   # prefix, residual rank inside the prefix
    done: dict = {}
    plen = 0
    # a stratum that is already small enough is ranked from its keys directly
    small = {(g, j): ("", r) for (g, j), (_p, r) in state.items() if sizes[g] <= leaf_rows}
    if small and not _rank_leaves(df, strata, small, state, done):
        return None
    while state:
        open_keys = {(g, p) for (g, _j), (p, _r) in state.items()}
        digits = DIGITS if len(open_keys) * 16 ** DIGITS <= COUNT_BUDGET else 2 if len(open_keys) * 256 <= COUNT_BUDGET else 1
        step = min(digits, length - plen)
        counts = (_under(df, strata, open_keys).groupBy(*strata, F.substring("_h", 1, plen + step).alias("_p"))
                  .count().collect())
        by_prefix: dict = {}
        for row in counts:
            g = tuple(row[c] for c in strata)
            by_prefix.setdefault((g, row["_p"][:plen]), []).append((row["_p"], row["count"]))
        leaf: dict = {}
        for (g, j), (p, r) in list(state.items()):
            acc = 0
            for nxt, cnt in sorted(by_prefix.get((g, p), [])):
                if r < acc + cnt:
                    state[(g, j)] = [nxt, r - acc]
                    if plen + step >= length:
                        if r > acc:  # the cut falls inside a run of equal hashes
                            return None
                        done[(g, j)] = nxt
                        del state[(g, j)]
                    elif cnt <= leaf_rows:
                        leaf[(g, j)] = (nxt, r - acc)
                    break
                acc += cnt
            else:
                raise RuntimeError("rank beyond stratum size")
        if leaf and not _rank_leaves(df, strata, leaf, state, done):
            return None
        plen += step
    return done


def _rank_leaves(df: DataFrame, strata: list[str], leaf: dict, state: dict, done: dict) -> bool:
    """Fetch the (bounded) hashes under each leaf prefix and pick the wanted rank; False on a tie at a cut."""
    rows = _under(df, strata, {(g, p) for (g, _j), (p, _r) in leaf.items()}).select(*strata, "_pre", "_h").collect()
    groups: dict = {}
    for row in rows:
        groups.setdefault((tuple(row[c] for c in strata), row["_pre"]), []).append(row["_h"])
    for v in groups.values():
        v.sort()
    for (g, j), (p, r) in leaf.items():
        cand = groups[(g, p)]
        if r and cand[r] == cand[r - 1]:
            return False
        done[(g, j)] = cand[r]
        del state[(g, j)]
    return True


def _apply_cuts(df: DataFrame, strata: list[str], cuts: dict, out: str) -> DataFrame:
    """Chunk index = number of cuts at or below the row's hash.

    With few strata the cuts become literals in one projection (no join); with many, a table of one
    row per stratum is broadcast and joined on the strata columns.
    """
    by_stratum: dict = {}
    for (g, j), key in cuts.items():
        by_stratum.setdefault(g, []).append((j, key))
    ordered = {g: [k for _j, k in sorted(v)] for g, v in by_stratum.items()}

    def count_below(keys):
        expr = F.lit(0)
        for k in keys:
            expr = expr + (F.col("_h") >= F.lit(k)).cast("int")
        return expr

    if not ordered:
        return df.withColumn(out, F.lit(0))
    if not strata:
        return df.withColumn(out, count_below(ordered[()]).cast("int"))
    if len(ordered) <= LITERAL_STRATA:
        expr = None
        for g, keys in ordered.items():
            cond = _stratum_match(strata, g)
            expr = F.when(cond, count_below(keys)) if expr is None else expr.when(cond, count_below(keys))
        return df.withColumn(out, F.coalesce(expr, F.lit(0)).cast("int"))
    table, same = _table(df, strata, [(*g, keys) for g, keys in ordered.items()], "_cuts array<string>")
    joined = df.join(table, same, "left")
    chunk = F.coalesce(F.size(F.filter(F.col("_cuts"), lambda c: F.col("_h") >= c)), F.lit(0))
    return joined.withColumn(out, chunk.cast("int")).drop("_cuts", *[f"_s{i}" for i in range(len(strata))])


def holdout_split(df: DataFrame, key_cols: list[str], test_frac: float = 0.2, seed: int = 42,
                  strata: list[str] | None = None, out: str = "is_test") -> DataFrame:
    """Flag exactly ceil(test_frac·n) rows (per stratum, if given) as test (1), the rest 0."""
    marked = assign_chunks(df, key_cols, lambda n: holdout_sizes(n, test_frac), strata, seed, "_chunk")
    return marked.withColumn(out, (F.col("_chunk") == 0).cast("int")).drop("_chunk")


def fraction_sample(df: DataFrame, key_cols: list[str], frac: float, seed: int = 42,
                    out: str = "in_sample") -> DataFrame:
    """Flag exactly round(frac·n) rows, like a seeded fractional sample."""
    def sizes(n):
        t = min(n, int(round(frac * n)))
        return [t, n - t]
    marked = assign_chunks(df, key_cols, sizes, None, seed, "_chunk")
    return marked.withColumn(out, (F.col("_chunk") == 0).cast("int")).drop("_chunk")


def holdout_and_folds(df: DataFrame, key_cols: list[str], test_frac: float = 0.2, k: int = 5, seed: int = 42,
                      strata: list[str] | None = None) -> DataFrame:
    """Hold-out flag and k folds of the remaining rows from one selection pass: in hash order the
    first ceil(test_frac·n) rows (per stratum) are the test set, the rest is cut into k folds.
    Adds ``is_test`` (1/0) and ``fold`` (-1 on test rows)."""
    def sizes(n):
        t = holdout_sizes(n, test_frac)[0]
        return [t] + kfold_sizes(n - t, k)
    marked = assign_chunks(df, key_cols, sizes, strata, seed, "_chunk")
    return (marked.withColumn("is_test", (F.col("_chunk") == 0).cast("int"))
                  .withColumn("fold", (F.col("_chunk") - 1).cast("int")).drop("_chunk"))


def kfold(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42, strata: list[str] | None = None,
          out: str = "fold") -> DataFrame:
    """Shuffled k-fold assignment (0..k-1), stratified when ``strata`` is given."""
    return assign_chunks(df, key_cols, lambda n: kfold_sizes(n, k), strata, seed, out)
