"""Chat formatting and conversation structure repair."""
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, example int, audit string, part int"


def _conv(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 7, "zzz", 9) for c, t, r, x in rows], SCHEMA)


ODD = [(1, 0, "system", "<|turn|>user<|text|>not a turn<|end|>"), (1, 1, "user", "a <| b \\| <\\\\| \\<| c\\"), (1, 2, "assistant", "<\\|end|><|end|>"),
       (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "last\n"),
       (2, None, None, None), (2, 1, "assistant", "x<"), (2, 1, "assistant", "x<"), (2, 1, "<|role|>", "|"),
       (None, 3, "assistant", "nobody"), (None, None, "user", "é ☃ \U0001f600"), (3, 0, "user", "only a question"),
       (4, 0, "user", "word " * 30_000), (4, 1, "assistant", "long " * 30_000)]


def _by_hand(rows):
    """n_turns, turns, replies of every conversation, by plain Python."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


# ---------------------------------------------------------------- chat formatting
def test_examples_hold_prefix_and_target(spark):
    from marmot.llm import chat as C
    rows = [(1, 0, "user", "one"), (1, 1, "assistant", "two"), (1, 2, "user", "three"), (1, 3, "assistant", "four"), (1, 4, "user", "five")]
    got = C.examples(_conv(spark, rows)).orderBy("example").collect()
    assert [r["n_turns"] for r in got] == [2, 4, 5] and [r["closes"] for r in got] == [False, False, True]
    assert got[0]["text"] == "<|turn|>user<|text|>one<|end|><|turn|>assistant<|text|>two<|end|>"
    assert [r["text"][r["loss_start"]:r["loss_end"]] for r in got] == ["two", "four", ""]
    assert got[1]["text"].startswith(got[0]["text"]) and got[2]["text"].startswith(got[1]["text"])


def test_chat_round_trip_of_odd_texts(spark, tmp_dir):
    from marmot.llm import chat as C
    made = C.examples(_conv(spark, ODD))
    made.write.parquet(f"{tmp_dir}/examples")
    for formatted in (made, spark.read.parquet(f"{tmp_dir}/examples")):
        got = {r["conv_id"]: r for r in C.digests(formatted).collect()}
        want = _by_hand(ODD)
        assert set(got) == set(want)
        for c, turns in want.items():
            said = "".join(x for r, x in turns if r == "assistant")
            assert got[c]["n_turns"] == len(turns), c
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), c
            assert got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest(), c
    assert C.digests(C.examples(_conv(spark, []))).count() == 0


def test_chat_long_conversation_and_groups_once(spark):
    from marmot.llm import chat as C
    rows = [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(601)]
    frame = C.digests(C.examples(_conv(spark, rows)))
    (got,) = frame.collect()
    assert got["n_turns"] == 601 and got["loss_chars"] == sum(len(x) for _, _, r, x in rows if r == "assistant")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.split("Initial Plan")[0].count("hashpartitioning") <= 1


def test_op11_matches_plain_python(spark):
    from marmot.llm.queries import QUERIES
    said = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = _by_hand([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = {r["conv_id"]: r for r in QUERIES["op11_chat_formatting"](spark, SF).collect()}
    assert set(got) == set(want) and got[-7]["loss_chars"] == len(said)
    for c, turns in want.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[c]["n_turns"] == len(turns)


# ---------------------------------------------------------------- structure repair
def _legal(s):
    return re.fullmatch("(s?(ua)+)?", s) is not None


def _dijkstra(turns):
    """Cheapest (cost, audit) by shortest paths over (rows used, role state), audits compared whole."""
    from marmot.llm import structure as R
    heap, best = [(0, "", 0, R.START)], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = (cost, audit)
        if i == len(turns) and state in (R.START, R.ASSISTANT):
            return cost, audit
        heapq.heappush(heap, (cost + 5, audit + "I", i, R.WANTED[state]))
        if i < len(turns):
            initial, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if text != R.GONE:
                more = 5 if text == R.CUT else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, R.WANTED[state]))
                if (state, initial) in R.KEPT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, R.KEPT[state, initial]))


def _enumerate(turns):
    """Cheapest edits among all sequences with at most two inserts in a row: no states, the regular expression decides."""
    found = []
    slots = [[""] if not i else ["", "u", "a", "ua", "au"] for i in range(2)][1]
    for edits in itertools.product("DKUA", repeat=len(turns)):
        if any(e != "D" and x == 1 for e, (_, x) in zip(edits, turns)):
            continue
        for ins in itertools.product(slots, repeat=len(turns) + 1):
            roles, audit, cost = ins[0], "I" * len(ins[0]), 5 * len(ins[0])
            for e, (initial, x), more in zip(edits, turns, ins[1:]):
                if e == "D":
                    audit, cost = audit + "D", cost + 2
                else:
                    roles += initial if e == "K" else e.lower()
                    audit, cost = audit + ("K" if e == "K" else "R"), cost + (e != "K") + (5 if x == 2 else 0)
                roles, audit, cost = roles + more, audit + "I" * len(more), cost + 5 * len(more)
            if _legal(roles):
                found.append((cost, audit))
    return min(found)


def test_cheapest_edits_by_enumeration():
    from marmot.llm import structure as R
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(25 if n else 1):
            turns = [(rng.choice("suuaa-"), rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]
            assert R.cheapest(turns) == _enumerate(turns), turns


@pytest.mark.parametrize("block", [1, 2, 5, 16, 24])
def test_cheapest_edits_by_shortest_paths(block):
    from marmot.llm import structure as R
    rng = random.Random(block)
    for k in range(200):
        n = rng.randint(0, 40)
        kinds = rng.choice(["suuaa-", "ua", "uuuuua", "sssu", "aaau", "--u"])
        turns = [(rng.choice(kinds), rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(n)]
        assert R.cheapest(turns, block) == _dijkstra(turns), turns


def test_long_conversations_stay_linear():
    from marmot.llm import structure as R
    rng = random.Random(1)
    for kinds in ("ua", "suuaa-", "u", "a", "s"):
        turns = [(rng.choice(kinds), rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(4_000)]
        cost, audit = R.cheapest(turns)
        assert len(audit.replace("I", "")) == 4_000 and cost <= 8_000
        assert (cost, audit) == _dijkstra_long(turns)


def _dijkstra_long(turns):
    """The same optimum by a table of linked prefixes (no search): costs first, then audits of ties letter by letter."""
    from marmot.llm import structure as R
    n = len(turns)
    inf = 10**9
    after = [[inf] * 4 for _ in range(n + 1)]  # least cost from (rows used, state) to the end
    for i in range(n, -1, -1):
        row = after[i]
        for s in range(4):
            c = 0 if i == n and s in (R.START, R.ASSISTANT) else inf
            if i < n:
                initial, text = turns[i]
                c = min(c, 2 + after[i + 1][s])
                if text != R.GONE:
                    more = 5 if text == R.CUT else 0
                    c = min(c, 1 + more + after[i + 1][R.WANTED[s]])
                    if (s, initial) in R.KEPT:
                        c = min(c, more + after[i + 1][R.KEPT[s, initial]])
            row[s] = c
        for _ in range(3):
            for s in range(4):
                row[s] = min(row[s], 5 + row[R.WANTED[s]])
    i, s, left, audit = 0, R.START, after[0][R.START], []
    while not (i == n and left == 0 and s in (R.START, R.ASSISTANT)):
        moves = []
        if i < n:
            initial, text = turns[i]
            more = 5 if text == R.CUT else 0
            moves.append(("D", i + 1, s, 2))
        moves.append(("I", i, R.WANTED[s], 5))
        if i < n and text != R.GONE:
            if (s, initial) in R.KEPT:
                moves.append(("K", i + 1, R.KEPT[s, initial], more))
            moves.append(("R", i + 1, R.WANTED[s], 1 + more))
        for letter, i2, s2, c in moves:  # in ASCII order
            if c + after[i2][s2] == left:
                audit.append(letter)
                i, s, left = i2, s2, left - c
                break
    return after[0][R.START], "".join(audit)


def _damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        r = "user" if fate == 4 else r
        out += [(c, t, r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def _summary(rows):
    """The contract's row for every conversation, by plain Python."""
    from marmot.llm import structure as R
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in _damaged(rows) if r[0] == c), key=order)
        known = {r[1] for r in own if r[1] is not None}
        turns, seen, n = [], set(), [0, 0, 0]
        for _, _, r, x in own:
            rest = x.strip(" \t\n\x0b\x0c\r")
            state = 0 if not rest else 1 if (r, x) in seen else 2 if rest[-1] not in ".!?" else 3
            if state < 3:
                n[state] += 1
            turns.append((r[0] if r[:1] in ("s", "u", "a") else "-", {0: R.GONE, 1: R.GONE, 2: R.CUT, 3: R.FINE}[state]))
            seen.add((r, x))
        cost, audit = _dijkstra(turns)
        state, at, lines = R.START, 0, []
        for letter in audit:
            if letter == "I":
                state = R.WANTED[state]
                lines.append(R.ROLE[state] + ":")
                continue
            _, _, r, x = own[at]
            initial = turns[at][0]
            at += 1
            if letter == "D":
                continue
            state = R.WANTED[state] if letter == "R" else R.KEPT[state, initial]
            lines.append((R.ROLE[state] if letter == "R" else r) + ":" + x)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[c] = (max(known) - min(known) + 1 - len(known) if known else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _check(spark, frame, rows):
    got = {r[0]: tuple(r[1:]) for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == _summary(rows)


def test_repair_of_odd_rows(spark):
    from marmot.llm import structure as R
    rows = [*ODD, (5, 7, "user", "same."), (5, 7, "user", "same."), (5, 9, "assistant", "Yes! \n"), (6, 1, "tool", "x."), (6, 2, "", "y."), (6, 3, "unit", "z."),
            (7, -4, "assistant", " \t\x0b"), (8, 2**40, "user", "far."), (8, 1, "assistant", "near."), *[(k, t, r, f"{t}.") for k in range(100, 160)
            for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]]
    _check(spark, R.summary(_conv(spark, rows)), rows)
    assert R.summary(_conv(spark, [])).count() == 0


def test_repaired_rows_are_legal(spark):
    from marmot.llm import structure as R
    turns = _conv(spark, [r for r in ODD if r[0] != 4])
    audits = R.plans(turns)
    out = R.repaired(turns, audits).collect()
    for c in {r["conv_id"] for r in out}:
        own = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["position"])
        assert _legal("".join(r["role"][0] for r in own)) and [r["position"] for r in own] == list(range(len(own)))


def test_op13_matches_plain_python(spark):
    from marmot.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _check(spark, QUERIES["op13_structure_repair"](spark, SF), rows)
