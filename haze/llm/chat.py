"""Chat formatting: the cheapest repair of a conversation's roles, then the rendered sequence.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending
with the assistant.  Every input turn is kept, merged into the turn before it, relabelled, or relabelled
and merged, and empty turns may be inserted; the cheapest repair is a shortest path through this
automaton.  Among equally cheap repairs the first option in the order of ``_options`` that
still reaches the optimum wins at each turn, so the result does not depend on how rows are dealt.

Turns are range-partitioned in conversation order and a long conversation runs over
several fragments.  A fragment is a min-plus matrix over the few states; matrices are folded from the
back into the cost to go behind each fragment, then each fragment walks forward once per possible entry
state, and a composition of these walks picks the real one.  One conversation with a third of all
turns is so many fragments, never one task.

Defined cases: order is by turn, then role and text (nulls last); null or unknown roles are
always relabelled; null text is empty; a null conversation id is a conversation; repeated rows are
turns of their own; an empty table gives an empty result; other columns, whatever their names, are not read; ``<|`` inside a text is rendered as ``<\\|`` so that no text can open a turn.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.session import ship_package, written

ROLES = ("system", "user", "assistant")
START = 0  # states: nothing yet, or 1 + index of the last turn's role
STATES = range(len(ROLES) + 1)
NEXT = {START: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (START, 3)
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40
ROWS_PER_FRAGMENT = 50_000


@lru_cache(maxsize=None)
def _inserts(a: int, b: int) -> tuple[int, ...] | None:
    """The shortest chain of inserted states that leads from ``a`` to ``b`` (first of equals)."""
    for n in range(len(ROLES) + 1):
        for chain in itertools.product(range(1, len(ROLES) + 1), repeat=n):
            path = (a, *chain)
            if path[-1] == b and all(y in NEXT[x] for x, y in zip(path, path[1:])):
                return chain
    return None


@lru_cache(maxsize=None)
def _options(state: int, role: str | None) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(cost, next state, action, inserted states) for one turn, in order of preference."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for to in ([own] if own else []) + [s for s in STATES if s and s != own]:
        relabel = 0 if to == own else RELABEL
        name = "keep" if to == own else "relabel"
        if to in NEXT[state]:
            out.append((relabel, to, name, ()))
        if to == state:
            out.append((relabel + MERGE, to, "merge" if to == own else "relabel+merge", ()))
        for mid in STATES:
            chain = _inserts(state, mid)
            if chain and to in NEXT[mid]:
                out.append((relabel + INSERT * len(chain), to, name, chain))
    return tuple(sorted(out, key=lambda o: (o[0], o[2] != "keep", o[2] != "merge", o[1], o[3])))


def _end_cost() -> list[int]:
    return [min([INSERT * len(c) for f in FINAL if (c := _inserts(s, f)) is not None], default=FAR) for s in STATES]


def _before(role: str | None, after: list[int]) -> list[int]:
    """Cost to go before a turn from the cost to go after it."""
    return [min([cost + after[to] for cost, to, _, _ in _options(s, role)], default=FAR) for s in STATES]


def matrix(roles: list[str | None]) -> list[list[int]]:
    """Cost between every pair of states around a fragment: column t is the cost to go to exactly state t."""
    cols = [[0 if s == t else FAR for s in STATES] for t in STATES]
    for role in reversed(roles):
        cols = [_before(role, c) for c in cols]
    return [[min(cols[t][s], FAR) for t in STATES] for s in STATES]


def walk(roles: list[str | None], entry: int, after: list[int]) -> tuple[list[tuple[int, str, tuple[int, ...]]], int]:
    """(state, action, inserted) of each turn on the preferred cheapest path, and the exit state."""
    to_go = [after]
    for role in reversed(roles):
        to_go.append(_before(role, to_go[-1]))
    to_go.reverse()
    out, state = [], entry
    for i, role in enumerate(roles):
        cost, to, action, chain = next(o for o in _options(state, role) if o[0] + to_go[i + 1][o[1]] == to_go[i][state])
        out.append((to, action, chain))
        state = to
    return out, state


def _runs(batches):
    """Runs of equal (conv, frag) in a sorted stream: first columns and the turns."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["frag"], row["conv"])
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _sorted(turns: DataFrame, n: int) -> DataFrame:
    return turns.repartitionByRange(n, "frag", "conv").sortWithinPartitions("frag", "conv", *_ORDER)


_ORDER = ["no_turn", "turn", "no_role", "role", "text_hash", "salt"]


def _turn(to: int, chain: tuple[int, ...], opens: bool, first: bool, text: str) -> str:
    body = (text or "").replace("<|", "<\\|")
    if not opens:
        return "\n\n" + body
    blank = "".join(f"<|{ROLES[s - 1]}|>\n<|end|>\n" for s in chain)
    return ("" if first else "<|end|>\n") + blank + f"<|{ROLES[to - 1]}|>\n{body}"


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", rows_per_fragment: int = ROWS_PER_FRAGMENT) -> DataFrame:
    """conv, turn, role, new_role, action, inserted (roles before it) and piece of every input turn.

    The pieces of a conversation, concatenated in order (frag, pos), are its rendered sequence; the
    last piece closes it.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    t = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("*", F.col("turn").isNull().alias("no_turn"), F.col("role").isNull().alias("no_role"),
                 F.md5(F.col("text").cast("binary")).alias("text_hash"), F.rand(7).alias("salt"))
    n = max(1, -(-conversations.count() // rows_per_fragment), min(spark.sparkContext.defaultParallelism, 8))
    dealt = written(t.repartitionByRange(n, "conv", *_ORDER).withColumn("frag", F.spark_partition_id()), "chat-turns")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    # conversations that span fragments: at most two fragments of each partition take part
    spans = dealt.select("conv", "frag").distinct()
    wide = spans.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select(F.col("conv").alias("c"))
    pieces = spans.join(wide, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias("c"), F.col("frag").alias("f"))
    pieces = written(pieces, "chat-wide")
    part = dealt.join(F.broadcast(pieces), F.col("conv").eqNullSafe(F.col("c")) & (F.col("frag") == F.col("f"))).drop("c", "f")

    def measure(batches):
        for (frag, conv), rows in _runs(batches):
            m = matrix([r["role"] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch_type), pa.array([frag], pa.int32()), pa.array([m])],
                                             ["conv", "frag", "m"])

    batch_type = _arrow_type(dealt, "conv")
    costs = written(_sorted(part, n).mapInArrow(measure, f"conv {kinds['conv']}, frag int, m array<array<bigint>>"), "chat-costs")

    def fold(frame):
        frame = frame.sort_values("frag")
        after, out = _end_cost(), []
        for m in reversed(list(frame["m"])):
            out.append(list(after))
            after = [min(row[t] + after[t] for t in STATES) for row in m]
        return frame.assign(after=out[::-1], first=[True] + [False] * (len(frame) - 1),
                            last=[False] * (len(frame) - 1) + [True])[["conv", "frag", "after", "first", "last"]]

    ends = written(costs.groupBy("conv").applyInPandas(
        fold, f"conv {kinds['conv']}, frag int, after array<bigint>, first boolean, last boolean"), "chat-ends")
    known = ends.select(F.col("conv").alias("c"), F.col("frag").alias("f"), "after", "first", "last")
    every = dealt.join(F.broadcast(known), F.col("conv").eqNullSafe(F.col("c")) & (F.col("frag") == F.col("f")), "left").drop("c", "f")

    def apply(batches):
        names = ["conv", "frag", "pos", "entry", "leave", "turn", "role", "new_role", "action", "inserted", "piece", "wide"]
        for (frag, conv), rows in _runs(batches):
            wide_, roles = rows[0]["after"] is not None, [r["role"] for r in rows]
            first, last = (rows[0]["first"], rows[0]["last"]) if wide_ else (True, True)
            after = list(rows[0]["after"]) if wide_ else _end_cost()
            out = []
            for entry in [START] if first else [s for s in STATES if s != START]:
                steps, leave = walk(roles, entry, after)
                for i, (r, (to, action, chain)) in enumerate(zip(rows, steps)):
                    opens = not action.endswith("merge")
                    text_ = _turn(to, chain, opens, first and i == 0, r["text"])
                    if last and i == len(rows) - 1:
                        text_ += "<|end|>\n" + "".join(f"<|{ROLES[s - 1]}|>\n<|end|>\n" for s in _closing(to))
                    out.append((conv, frag, i, entry, leave, r["turn"], r["role"], ROLES[to - 1], action,
                                [ROLES[s - 1] for s in chain], text_, wide_))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, arrow)], names)

    arrow = [batch_type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), _arrow_type(dealt, "turn"), pa.string(), pa.string(),
             pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    walked = written(_sorted(every, n).mapInArrow(
        apply, f"conv {kinds['conv']}, frag int, pos long, entry int, leave int, turn {kinds['turn']}, role string, "
               "new_role string, action string, inserted array<string>, piece string, wide boolean"), "chat-walks")

    def compose(frame):
        state, out = START, []
        for frag, rows in frame.sort_values("frag").groupby("frag"):
            out.append((rows["conv"].iloc[0], frag, state))
            state = int(rows.loc[rows["entry"] == state, "leave"].iloc[0])
        return type(frame)(out, columns=["conv", "frag", "entry"])

    routes = walked.where("wide").select("conv", "frag", "entry", "leave").distinct().groupBy("conv").applyInPandas(
        compose, f"conv {kinds['conv']}, frag int, entry int")
    real = F.broadcast(written(routes, "chat-routes").select(
        F.col("conv").alias("c"), F.col("frag").alias("f"), F.col("entry").alias("e")))
    chosen = walked.where("wide").join(real, F.col("conv").eqNullSafe(F.col("c")) & (F.col("frag") == F.col("f"))
                                       & (F.col("entry") == F.col("e")))
    return walked.where(~F.col("wide")).unionByName(chosen.drop("c", "f", "e")).drop("entry", "leave", "wide")


def _closing(state: int) -> tuple[int, ...]:
    return min(((len(c), c) for f in FINAL if (c := _inserts(state, f)) is not None))[1]


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
