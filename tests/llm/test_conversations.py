"""Conversation repair and prefix trie against brute force, with nulls, ties, repeats, empty and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from trajlens.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, depth int, gone_by string, `h` int, place int, fate int"


def table(spark, rows):
    return spark.createDataFrame([(*row, 9, 9, "clash", 9, 9, 9) for row in rows], SCHEMA)


def odd_rows(seed, count=500, ids=300):
    draw = random.Random(seed)
    texts = ["a.", "bb", "", None, " \t", "c?!", "a", "long text " * 400 + "."]
    return [
        (draw.randrange(ids), draw.choice([None, 0, 1, 2, 2, 5]), draw.choice(["user", "assistant", "system", "tool", None, ""]),
         draw.choice(texts))
        for _ in range(count)
    ]


def least_repair(rows, costs):
    """All edit sequences with at most three inserts; rows are (turn, role, text, fault)."""
    best = None

    def go(place, inserts, run, cost, audit, signs, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if place == len(rows) and re.fullmatch("(s?(ua)+)?", signs) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if inserts < 3 and run < 2:
            for role in ("user", "assistant"):
                go(place, inserts + 1, run + 1, cost + costs.insert, audit + "I", signs + role[0], [*lines, (role, "")])
        if place < len(rows):
            _, role, text, fault = rows[place]
            go(place + 1, inserts, 0, cost + costs.delete, audit + "D", signs, lines)
            if fault in ("blank", "duplicate"):
                return
            more = costs.truncated if fault else 0
            if role[:1] and role[0] in "sua":
                go(place + 1, inserts, 0, cost + costs.keep + more, audit + "K", signs + role[0], [*lines, (role, text)])
            for new in ("user", "assistant"):
                go(place + 1, inserts, 0, cost + costs.rerole + more, audit + "R", signs + new[0], [*lines, (new, text)])

    go(0, 0, 0, 0, "", "", [])
    return best


def faulted(rows):
    out, seen = [], set()
    for turn, role, text in rows:
        out.append((turn, role, text, conversation_repair.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    return out


def test_repair_is_the_least_of_all(monkeypatch):
    draw = random.Random(5)
    for trial in range(400):
        monkeypatch.setattr(conversation_repair, "WINDOW", draw.choice([1, 2, 3, 256]))
        costs = conversation_repair.Costs()
        if trial % 2:
            costs = conversation_repair.Costs(0, draw.randrange(3), draw.randrange(4), draw.randrange(1, 4), draw.randrange(4))
        rows = faulted([
            (n, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b", "", "c?"])) for n in range(draw.randrange(6))
        ])
        repair = conversation_repair.Repair(costs)
        edits = [edit for row in rows for edit in repair.add(row)] + repair.finish()
        lines = [edit[5:] for edit in edits if edit[3] != "D"]
        assert (sum(edit[4] for edit in edits), "".join(edit[3] for edit in edits), lines) == least_repair(rows, costs)


@pytest.mark.parametrize("noise", [0, 0.1, 0.5])
def test_long_conversations_are_not_held(noise):
    draw, repair, open_rows = random.Random(2), conversation_repair.Repair(), 0
    for turn in range(20_000):
        role = "user" if turn % 2 == 0 or draw.random() < noise else "assistant"
        repair.add((turn, role, "x.", None))
        open_rows = max(open_rows, len(repair.rows) + len(repair.waiting))
    repair.finish()
    assert open_rows <= 2 * conversation_repair.WINDOW


def brute_summary(rows, costs=conversation_repair.Costs()):
    """Damaged and repaired conversation from its raw rows."""
    conv = rows[0][0]
    after = []
    for _, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        after += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    after.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
    turns = {turn for turn, _, _ in after if turn is not None}
    found = faulted(after)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
    cost, audit, lines = least_repair(found, costs)
    faults = [row[3] for row in found]
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit,
        hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest(),
    )


def test_summaries_against_brute_force(spark):
    rows = [*odd_rows(1), (None, 1, "user", "x."), (None, None, "assistant", "y.")]
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    found = conversation_repair.summaries(conversation_repair.repaired(conversation_repair.damaged(table(spark, rows)))).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(brute_summary(group)) for group in groups.values())


def test_repaired_turns_and_empty_tables(spark):
    turns = table(spark, [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Yes."), (2, 1, "user", None)])
    rows = [tuple(row) for row in conversation_repair.repaired(turns).collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 1, None, "user", "K", 0, "user", "Hi."), (1, 2, "duplicate", "user", "D", 2, None, None),
        (1, 3, None, "tool", "R", 1, "assistant", "Yes."), (2, 1, "blank", "user", "D", 2, None, None),
    ], key=str)
    assert conversation_repair.summaries(conversation_repair.repaired(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        conversation_repair.Costs(insert=0)


def brute_trie(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [row[2:] for row in sorted(group)] for conv, group in groups.items()}
    paths = {}
    for conv, turns in own.items():
        size = zlib.crc32(str(conv).encode()) % 6
        paths[conv] = tuple(own.get(conv - conv % 100, [])[:size] + turns[size:])
    members, children = defaultdict(list), defaultdict(set)
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
            if depth:
                children[path[: depth - 1]].add(path[:depth])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[child] for child in children[node]) or 1
        saved[node] = sum(saved[child] for child in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((
        min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(str(conv) for conv in sorted(ids) if paths[conv] == node).encode()).hexdigest(),
    ) for node, ids in members.items())


@pytest.mark.parametrize("turns_per_task", [100_000, 60, 9])
def test_trie_against_brute_force(spark, turns_per_task):
    rows = odd_rows(2, 700, 250) + [(conv, turn, "user", "same") for conv in range(400, 460) for turn in range(3)]
    rows += [(1000 + n, turn, "user", f"t{turn * (turn > 40 - n)}") for n in range(6) for turn in range(40 - n)] + [(None, 1, "user", "x")]
    found = prefix_trie.trie(prefix_trie.rebuilt(table(spark, rows)), turns_per_task)
    assert found.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_trie(rows), key=str)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(table(spark, []))).count() == 0
