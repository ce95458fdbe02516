"""Conversation tries and repairs against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlane.llm import conversation_repair as cr
from ledgerlane.llm import conversation_trie as ct

TURNS = "conv_id bigint, turn bigint, role string, text string"


def by_turn(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    return groups


def name(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(turns):
    """Turns of one number come by their digests, as the operator says."""
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, name(t[1] or "", t[2] or "")))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- trie -------------------------------------------------------------------
def plain_trie(rows):
    originals = {c: [(r or "", t or "") for _, r, t in in_order(turns)] for c, turns in by_turn(rows).items() if c is not None}
    rebuilt = {}
    for c, turns in originals.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(originals.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo = [node]
        while todo:
            one = todo.pop()
            yield one
            todo += children[one]

    return Counter(
        (min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]),
         sum(not children[x] for x in below(node)),
         sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below(node) if x),
         sha(",".join(str(c) for c in sorted(ids) if rebuilt[c] == node)))
        for node, ids in members.items())


def conversations(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randrange(1, longest)):
            rows.append((c * 3, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(ct, "BLOCK_ROWS", block)
    rows = conversations(1, 60, ["a", "bé"], 5) + conversations(2, 4, ["x"], 30)
    rows += [(900 + 7 * k, t, "user", "same") for k in range(40) for t in range(3)]  # copies
    rows += [(5000, None, None, None), (5000, 3, "user", ""), (5000, 1, None, "q"), (None, 0, "user", "lost"), (5001, 0, "user", "z" * 300_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS names", "2 AS part", "3 AS key").repartition(5)
    got = Counter(tuple(r) for r in ct.prefix_trie(df).collect())
    assert got == plain_trie(rows)


def test_trie_with_blocks_of_two_in_one_partition(spark):
    """Every block asks its neighbours."""
    rows = [(k, t, "user", "same" if t < k % 4 else str(k % 2)) for k in range(30) for t in range(6)]
    old, ct.BLOCK_ROWS, pieces, ct.PIECE_TURNS = ct.BLOCK_ROWS, 2, ct.PIECE_TURNS, 2
    try:
        batches = spark.createDataFrame(rows, TURNS).toArrow()
        assert batches.num_rows == len(rows)
        sequences = {c: [(r, t) for _, r, t in turns] for c, turns in by_turn(rows).items()}
        named = sorted((b"".join(hashlib.md5(repr(x).encode()).digest() for x in turns), c) for c, turns in sequences.items())
        lcps = [-1] + [ct.shared(a[0], b[0]) for a, b in itertools.pairwise(named)] + [-1]
        total = Counter()
        for start in range(0, len(named), 2):
            some = named[start:start + 2]
            table = ct.block_nodes({
                "part": 0, "block": start, "conv_ids": [c for _, c in some], "lcps": lcps[start:start + len(some)], "lengths": [6] * len(some),
                "sizes": [len(t) for _, c in some for _, t in sequences[c]], "first": some[0][0], "last": some[-1][0],
                "left": lcps[start], "right": lcps[start + len(some)]})
            for node in table.to_pylist():
                total["saved", node["depth"]] += node["saved_tokens"]
                total["members", node["depth"]] += node["n_convs"]
        for d in range(7):
            assert total["members", d] == 30
        nodes = defaultdict(set)
        for c, turns in sequences.items():
            for d in range(7):
                nodes[tuple(turns[:d])].add(c)
        want = Counter()
        for node, ids in nodes.items():
            for d in range(len(node) + 1):
                want[d] += (len(ids) - 1) * len(node[-1][1]) if node else 0
        assert {d: total["saved", d] for d in range(7)} == {d: want[d] for d in range(7)}
    finally:
        ct.BLOCK_ROWS, ct.PIECE_TURNS = old, pieces


# --- repair -----------------------------------------------------------------
def all_edits(codes):
    """The least (cost, letters), by trying everything."""
    best = None

    def go(i, state, cost, letters, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes) and state in (0, 3):
            best = min(best or (cost, letters), (cost, letters))
        if inserted < 2:
            for role, after in cr.NEXT[state].items():
                if role != "s":
                    go(i, after, cost + 3, letters + "I", inserted + 1)
        if i < len(codes):
            go(i + 1, state, cost + 4, letters + "D", 0)
            extra = 3 if codes[i].isupper() else 0
            for role, after in cr.NEXT[state].items():
                if codes[i] != "x" and role != "s":
                    go(i + 1, after, cost + 3 + extra, letters + "R", 0)
                if codes[i].lower() == role:
                    go(i + 1, after, cost + extra, letters + "K", 0)

    go(0, 0, 0, "", 0)
    return best


def suffixes(codes):
    """The least (cost, letters) of longer conversations, from their end."""
    best = {0: (0, ""), 3: (0, ""), 1: (6, "II"), 2: (3, "I")}

    def inserted(table):
        for _ in range(3):
            for state in range(4):
                for role, after in cr.NEXT[state].items():
                    if role != "s":
                        table[state] = min(table[state], (table[after][0] + 3, "I" + table[after][1]))
        return table

    best = inserted(best)
    for code in reversed(codes):
        extra, table = 3 if code.isupper() else 0, {}
        for state in range(4):
            ways = [(best[state][0] + 4, "D" + best[state][1])]
            for role, after in cr.NEXT[state].items():
                cost, letters = best[after]
                if code != "x" and role != "s":
                    ways.append((cost + 3 + extra, "R" + letters))
                if code.lower() == role:
                    ways.append((cost + extra, "K" + letters))
            table[state] = min(ways)
        best = inserted(table)
    return best[0]


def test_cheapest_edits():
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choice("suaSUAoxuaUA") for _ in range(rng.randrange(6)))
        want = all_edits(codes)
        assert suffixes(codes) == want == cr.finish(cr.routes(codes, 0)), codes
    for _ in range(30):
        codes = "".join(rng.choice("suaSUAoxuaUA") for _ in range(rng.randrange(2, 80)))
        cut = rng.randrange(1, len(codes))
        one, two = [[cr.routes(part, s) for s in range(4)] for part in (codes[:cut], codes[cut:])]
        assert suffixes(codes) == cr.finish(cr.routes(codes, 0)) == cr.finish(cr.chained(one, two)[0]), codes


SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    damaged = by_turn(plain_damage(rows))
    result = set()
    for conv in {r[0] for r in rows}:
        # turns of one number by role and digest, as the operator says
        turns = sorted(damaged[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], name(t[1], t[2])))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, codes, counts = set(), "", Counter()
        for _, role, text in turns:
            body, letter = text.rstrip(SPACES), role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not body:
                counts["blank"] += 1
                codes += "x"
            elif (role, text) in seen:
                counts["duplicate"] += 1
                codes += "x"
            elif body[-1] not in ".!?":
                counts["truncated"] += 1
                codes += letter.upper()
            else:
                codes += letter
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = suffixes(codes)
        lines, at, state = [], 0, 0
        for letter in audit:
            if letter in "IR":
                role = "assistant" if state == 2 else "user"
                lines.append(f"{role}:{'' if letter == 'I' else turns[at][2]}")
                state = 3 if state == 2 else 2
            elif letter == "K":
                lines.append(f"{turns[at][1]}:{turns[at][2]}")
                state = cr.NEXT[state][turns[at][1][0]]
            at += letter != "I"
        result.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return result


@pytest.mark.parametrize("piece", [1024, 3])
def test_damage_and_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE_ROWS", piece)
    monkeypatch.setattr(cr, "FAN_IN", 4)
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t", "Why?", "so!\n", "été."]
    rows = [
        (c, None if rng.random() < 0.05 else turn * 2, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(texts + [f"Text {rng.random()}."] * 9 + [None]))
        for c in range(70) for turn in range(rng.randrange(1, 12))]
    rows += [(500, turn, "user" if turn % 2 else "assistant", f"{turn % 40} said.") for turn in range(300)]
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Nobody."), (600, 0, "user", "w" * 200_000), (600, 1, "assistant", "Short.")]
    alone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "Goes away."))
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS piece", "'x' AS report", "2 AS fault").repartition(3)
    got = {tuple(r) for r in cr.damage_and_repair(df).collect()}
    assert got == plain_repair(rows)


def test_a_conversation_with_most_rows_is_cut(spark, monkeypatch):
    """Its pieces come from several partitions, none of them large."""
    monkeypatch.setattr(cr, "PIECE_ROWS", 50)
    rows = [(1, turn, "user" if turn % 2 == 0 else "assistant", f"Turn {turn}.") for turn in range(2000)]
    pieces = cr.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert len(pieces) >= 40 and {p.pieces for p in pieces} == {len(pieces)} and max(len(p.repaired) for p in pieces) <= 52
    joined = [(t.role, t.text) for p in sorted(pieces, key=lambda p: p.piece) for t in p.repaired]
    assert joined == [(r[2], r[3]) for r in rows]


def test_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert ct.prefix_trie(empty).collect() == [] and cr.damage_and_repair(empty).collect() == []
