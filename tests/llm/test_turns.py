"""Conversation repair against a table over all states, and segments against whole conversations."""

import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from invoicelens.llm import turn_alignment as ta, turn_repair as tr

FOLDER = "/root/testdata/sf0.01"
#: What a string of the grammar may go on with, by its last letter.
NEXT = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}


def cheapest(turns, start="", ends=("", "a")):
    """The least (cost, script), by relaxing all states turn by turn."""
    def insertions(states):
        for _ in range(6):
            for state, (cost, script) in list(states.items()):
                for to in NEXT[state]:
                    if to != "s":
                        made = (cost + 5, script + "I")
                        states[to] = min(states.get(to, made), made)
        return states

    states = insertions({start: (0, "")})
    for turn in turns:
        after = {}
        for state, (cost, script) in states.items():
            moves = [(state, 2, "D")]
            if turn != "D":
                late = 5 if turn.isupper() else 0
                moves += [(to, late, "K") for to in NEXT[state] if to == turn.lower()]
                moves += [(to, 1 + late, "R") for to in NEXT[state] if to != "s"]
            for to, more, edit in moves:
                made = (cost + more, script + edit)
                after[to] = min(after.get(to, made), made)
        states = insertions(after)
    return min((states[e] for e in ends if e in states), default=None)


def by_hand(rows):
    """Contract of op11 over rows (conv_id, turn, role, text)."""
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return {conv: judged(turns) for conv, turns in out.items()}


def judged(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    letters, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for _, role, text in turns:
        shown = text.strip(" \t\n\v\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        letter = role[:1] if role[:1] and role[:1] in "sua" else "x"
        letters += "D" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        if fault:
            counts[fault] += 1
    numbers = [t for t, _, _ in turns if t is not None]
    cost, audit = cheapest(letters)
    state, at, left = "", 0, []
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            left.append(f"{'assistant' if state == 'a' else 'user'}:")
            continue
        _, role, text = turns[at]
        at += 1
        if edit == "R":
            role = "assistant" if state == "u" else "user"
        if edit != "D":
            state = role[:1]
            left.append(f"{role}:{text}")
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)),
            cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def found(audits):
    rows = audits.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in tr.RESULT) for r in rows}


def test_alignment_against_all_states():
    pick = random.Random(5)
    for _ in range(1500):
        turns = "".join(pick.choice("suaxSUAXD") for _ in range(pick.randint(0, 9)))
        for start in ta.STATES:
            for end in ta.STATES:
                assert ta.best_script(turns, start, end) == cheapest(turns, start, (end,)), (turns, start, end)


def test_parts_chain_to_the_whole():
    pick, aligner = random.Random(6), tr.Aligner()
    for _ in range(60):
        turns = "".join(pick.choice("suauauaxUAD") for _ in range(pick.randint(0, 90)))
        assert aligner.whole(turns) == cheapest(turns), turns


def test_query_against_brute_force(spark):
    from invoicelens.llm import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_turn_repair(spark, FOLDER)) == by_hand(rows)


def odd_rows():
    pick, said = random.Random(7), ["Yes.", "No", "Why?", " ", "", None, "It is so.", "So.\n", "\x00!", "ß é 日本."]
    rows = [(1, n, pick.choice(["user", "assistant", "system", "tool", "", None]), pick.choice(said)) for n in range(900)]
    rows += [(2, None, "user", "Null turn."), (2, 3, "assistant", "ok."), (2, 7, "user", "x" * 60_000), (None, 1, "user", "Hi."),
             (None, None, None, None), (None, 2, "assistant", "Ho."), (5, 0, "user", "Same."), (5, 0, "user", "Same."), (5, 1, "assistant", "Yes.")]
    rows += [(9, n, "user" if n % 2 == 0 else "assistant", f"Turn {n}.") for n in range(700)]
    rows += [(c, n, "user", "t.") for c in range(100, 160) for n in range(c % 3)]
    return rows


def test_odd_and_long_conversations(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost double, audit string")
    assert found(tr.audit_conversations(tr.damaged(frame.repartition(7)))) == by_hand(rows)
    assert tr.audit_conversations(tr.damaged(frame.limit(0))).count() == 0


def test_repaired_turns_fit_the_digest(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = tr.repaired_turns(tr.damaged(frame)).orderBy("conv_id", "task", "place", "at").collect()
    hand = by_hand(rows)
    for conv in (1, 2, 9, None):
        left = [f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv]
        assert hashlib.sha256("\n".join(left).encode()).hexdigest() == hand[conv][-1]


def test_whole_rows_keep_what_is_right(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], "conv_id int, turn int, role string, text string")
    assert [(r["cost"], r["audit"]) for r in tr.audit_conversations(tr.whole(frame)).collect()] == [(0, "KK")]


def test_rows_split_over_tasks(spark):
    rows = [(1, n // 3, "user" if n % 2 else "assistant", f"w{n % 400}.") for n in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = tr._ordered(tr.damaged(frame)).select(F.spark_partition_id()).distinct().count()
        assert tasks > 1 and found(tr.audit_conversations(tr.damaged(frame))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
