import itertools
import random
import re
from collections import defaultdict

import __spark_entry__ as E
from haze.llm import chat

SF = "/root/testdata/sf0.001"


def brute_cost(roles):
    """Cheapest repair by trying every labelling, merge choice and insertion."""
    best = 10**9
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((0, 1), repeat=len(roles)):
            cost, state = 0, 0
            for r, to, m in zip(roles, labels, merged):
                cost += 0 if r in chat.ROLES and chat.ROLES.index(r) + 1 == to else chat.RELABEL
                if m:
                    cost += chat.MERGE if to == state else 10**9
                    continue
                chains = [len(c) for mid in chat.STATES if to in chat.NEXT[mid] and (c := chat._inserts(state, mid)) is not None]
                cost += chat.INSERT * min(chains, default=10**9)
                state = to
            cost += min([chat.INSERT * len(c) for f in chat.FINAL if (c := chat._inserts(state, f)) is not None], default=10**9)
            best = min(best, cost)
    return best


def cost_of(steps, leave):
    price = {"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "relabel+merge": chat.RELABEL + chat.MERGE}
    return sum(price[a] + chat.INSERT * len(c) for _, a, c in steps) + chat.INSERT * len(chat._closing(leave))


def test_dynamic_program_is_optimal():
    for n in range(5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            steps, leave = chat.walk(list(roles), chat.START, chat._end_cost())
            assert cost_of(steps, leave) == brute_cost(roles)


def legal(text):
    roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and text.count("<|end|>") == len(roles)


def plain(turns):
    """Rendered text of one conversation, computed without fragments."""
    rows = sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1] is None, t[1] or "", __import__("hashlib").md5((t[2] or "").encode()).hexdigest()))
    steps, leave = chat.walk([r[1] for r in rows], chat.START, chat._end_cost())
    out = "".join(chat._turn(to, c, not a.endswith("merge"), i == 0, r[2]) for i, (r, (to, a, c)) in enumerate(zip(rows, steps)))
    return out + "<|end|>\n" + "".join(f"<|{chat.ROLES[s - 1]}|>\n<|end|>\n" for s in chat._closing(leave))


def rendered(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv"]].append((r["frag"], r["pos"], r["piece"]))
    return {c: "".join(p for _, _, p in sorted(v)) for c, v in by.items()}


def test_query_is_legal_and_keeps_every_turn(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = E.queries()["op5_chat_repair"](spark, SF).collect()
    assert len(rows) == table.count()
    by = defaultdict(list)
    for r in table.collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = rendered(chat.repaired(table).collect())
    assert got == {c: plain(t) for c, t in by.items()} and all(map(legal, got.values()))


def test_fragments_do_not_change_the_result(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool", None]), f"t{i % 40} <|user|>") for i in range(400)]
    rows += [(c, rng.choice([None, 1, 2, 3]), rng.choice(["user", "assistant", "system"]), rng.choice([None, "", "hey"]))
             for c in [None, 2, 3, 4] for _ in range(rng.randrange(1, 12))]
    rows += [(5, 1, "user", "same")] * 30
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, frag int")
    by = defaultdict(list)
    for c, *t in rows:
        by[c].append(tuple(t))
    want = {c: plain(t) for c, t in by.items()}
    for size in (7, 60, 10_000):
        out = chat.repaired(df, rows_per_fragment=size).collect()
        assert len(out) == len(rows)
        assert rendered(out) == want and all(map(legal, want.values()))
    assert chat.repaired(df.limit(0)).count() == 0
