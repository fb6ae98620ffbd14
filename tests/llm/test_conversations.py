"""Repair of conversations and the trie of their prefixes against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.llm import conversations, prefix_trie, turn_repair

FIELDS = "conv_id bigint, turn bigint, role string, text string"
CLASHING = ["1 AS again", "2 AS fault", "'x' AS letters", "3 AS path", "4 AS KIND", "5 AS present", "6 AS turns", "7 AS one"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_audit(turns):
    """One conversation in order: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    kinds, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
    after = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may come after a role

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = []
        if i == len(turns) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            role = "a" if last == "u" else "u"
            cost, audit, rest = best(i, role, inserted + 1)
            options.append((cost + 2, "I" + audit, ((role, None), *rest)))
        if i < len(turns):
            cost, audit, rest = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, rest))
            if kinds[i] not in ("blank", "duplicate"):
                late, initial = int(kinds[i] == "truncated"), turns[i][1][:1]
                if initial and initial in after[last]:
                    cost, audit, rest = best(i + 1, initial, 0)
                    options.append((cost + late, "K" + audit, ((None, i), *rest)))
                for role in "ua":
                    if role in after[last]:
                        cost, audit, rest = best(i + 1, role, 0)
                        options.append((cost + late + 2, "R" + audit, ((role, i), *rest)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    cost, audit, path = best(0, "", 0)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{turns[i][1] if role is None else names[role]}:{'' if i is None else turns[i][2]}" for role, i in path]
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, *counts.values(), illegal, cost, audit, sha("\n".join(lines)), lines


def ordered(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda o: (o[0] is not None, o[0] or 0, o[1], o[2]))


def made_turns(seed, convs=60):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "admin"], ["Yes.", "No!", "half", "", " \n", None, "a?\t ", "b ", "line\nline."]
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(draw.randint(1, 9)):
            role = draw.choice(roles[:2]) if draw.random() < 0.7 else draw.choice(roles)
            text = f"t{draw.randint(0, 4)}." if draw.random() < 0.6 else draw.choice(texts)
            rows.append((conv, draw.choice([None, *range(8)]), role, text))
            if draw.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_a_plain_version(spark, seed):
    rows = made_turns(seed)
    frame = spark.createDataFrame(rows, FIELDS).repartition(5).selectExpr("*", *CLASHING)
    want = {conv: plain_audit(ordered([r for r in rows if r[0] == conv])) for conv in {r[0] for r in rows}}
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.audits(frame).collect()}
    assert got == {conv: audit[:-1] for conv, audit in want.items()}
    lines = {}
    for r in turn_repair.repaired(frame).orderBy("conv_id", "place").collect():
        assert r.edit in "KRI" and r.place == len(lines.setdefault(r.conv_id, [])) + 1
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {conv: audit[-1] for conv, audit in want.items() if audit[-1]}
    for audit in want.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in audit[-1]))


def test_long_conversations_and_none(spark):
    draw = random.Random(5)
    rows = [(7, k, draw.choice(["user", "assistant", "system"]), draw.choice([f"t{k}.", f"t{k}", "again."])) for k in range(3000)]
    got = turn_repair.audits(spark.createDataFrame(rows, FIELDS)).first()
    # The recursion of the plain version is as deep as the conversation: the cost alone, layer by layer.
    seen, behind = set(), {"": 0}
    for _, _, role, text in rows:
        gone, late = (role, text) in seen, int(text[-1] != ".")
        seen.add((role, text))
        for _ in range(2):
            for last, cost in list(behind.items()):
                new = "a" if last == "u" else "u"
                behind[new] = min(behind.get(new, 10**9), cost + 2)
        ahead = {last: cost + 3 for last, cost in behind.items()}
        for last, cost in behind.items():
            for role_, more in () if gone else ((role[0], late), ("u", late + 2), ("a", late + 2)):
                if role_ in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                    ahead[role_] = min(ahead.get(role_, 10**9), cost + more)
        behind = ahead
    assert got.cost == min(behind.get("", 10**9), behind.get("a", 10**9), behind.get("u", 10**9) + 2)
    assert turn_repair.audits(spark.createDataFrame([], FIELDS)).count() == 0
    nothing = turn_repair.audits(spark.createDataFrame([(1, 0, "user", "x"), (1, None, None, None)], FIELDS), F.lit(False)).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_auction_prices_are_shortest_distances():
    for later in [(0, 4, 2, 0), (1, 0, 3, 2), (0, 0, 0, 0), (5, 1, 0, 7)]:
        for kind in ["x", "u", "ut", "a", "at", "s", "st", "o", "ot"]:
            want = [10**9] * 4
            for _ in range(5):  # as often as there are nodes
                want = [min(c + (later if ahead else want)[to] for _, c, to, ahead in turn_repair.arcs(kind, s)) for s in range(4)]
            assert list(turn_repair.auction(kind, later)[0]) == want


def test_one_shuffle_in_the_repair(spark):
    frame = spark.createDataFrame(made_turns(3), FIELDS)
    plan = turn_repair.audits(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two!") for k in range(30) for t in (0, 1)] + [(None, 0, "user", None), (5, None, None, "x")]
    got = conversations.damaged(spark.createDataFrame(rows, FIELDS)).collect()
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(str(conv), str(turn), "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert sorted((str(r.conv_id), str(r.turn), r.role, r.text, r.stays) for r in got) == sorted(want)


def plain_trie(turns):
    """Nodes of {conv: [(digest, words)]}: {(conv_id, depth): row}."""
    members, ends = {}, {}
    for conv, seq in turns.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(conv)
        ends.setdefault(tuple(seq), []).append(conv)
    rows = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * n[-1][1] for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        listed = sha(",".join(map(str, sorted(ends.get(node, [])))))
        rows.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, listed))
    return rows


def made_conversations(seed, convs=70):
    draw = random.Random(seed)
    rows = []
    for conv in draw.sample(range(-50, 20_000), convs):
        length = draw.choice([1, 1, 2, 3, 5])
        # Few different turns, so that prefixes are shared; a third of the conversations are alike.
        same = draw.random() < 0.35
        for turn in range(length if not same else 3):
            text = "hot topic." if same else " ".join(draw.choice("ab") for _ in range(draw.randint(0, 2)))
            rows.append((conv, None if turn == 0 else turn, draw.choice(["user", None]) if not same else "user", text or draw.choice(["", None])))
    return rows


def listed(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role)}:{role}{text}")[:32]
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


@pytest.mark.parametrize("seed, fan", [(1, 256), (2, 256), (3, 2)])
def test_trie_against_a_plain_version(spark, monkeypatch, seed, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)  # two: spines merge over several levels
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 4)
    rows = made_conversations(seed) + [(None, 1, "user", "lost")] + [(3, 9, "user", "twice"), (3, 9, "user", "twice")]
    frame = spark.createDataFrame(rows, FIELDS).repartition(4).selectExpr("*", *CLASHING)
    got = {tuple(r) for r in prefix_trie.nodes(prefix_trie.sequences(frame)).collect()}
    assert got == plain_trie(listed(rows))


def test_rebuilt_conversations(spark):
    rows = [(k, t, "user", f"{k} {t}") for k in [0, 3, 7, 19, 20, 21, 45, 60, 61] for t in range(k % 5 + 1)]
    turns, want = listed(rows), {}
    for conv, own in turns.items():
        lent = zlib.crc32(str(conv).encode()) % 4
        want[conv] = turns.get(conv - conv % 20, [])[:lent] + own[lent:]
    frame = conversations.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, FIELDS)))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in frame.collect()} == want
    assert any(not turns for turns in want.values())  # turnless ones end at the root
    assert {tuple(r) for r in prefix_trie.nodes(frame).collect()} == plain_trie(want)
    empty = spark.createDataFrame([], FIELDS)
    assert prefix_trie.nodes(conversations.rebuilt(prefix_trie.sequences(empty))).count() == 0


def test_parentheses():
    draw = random.Random(6)
    for nodes in [1, 2, 5, 60, 500, 3000]:
        depth = [0]
        for _ in range(nodes - 1):
            depth.append(draw.randint(max(1, depth[-1] - 30), depth[-1] + 1))
        shape = prefix_trie.Parentheses(np.array(depth))
        close, stack, place = shape.findclose(), [], {}
        for at, opened in enumerate(shape.bits):
            stack.append(at) if opened else place.__setitem__(stack.pop(), at)
        assert not stack and [place[at] for at in shape.open] == close.tolist()


def test_a_chain_of_many_turns(spark):
    rows = [(k, t, "user", f"turn {t}" if k or t < 900 else "other") for k in range(3) for t in range(1000)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.nodes(prefix_trie.sequences(spark.createDataFrame(rows, FIELDS))).collect()}
    assert len(got) == 1 + 900 + 100 + 100 and got[0, 0].n_leaves == 2 and got[0, 0].saved_tokens == 2 * (2 * 900 + 100)
