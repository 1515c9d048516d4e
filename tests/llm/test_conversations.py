"""Conversation repair against plain versions: all edits of short conversations, a shortest path for longer ones, and hashing written out."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversations as conv

BLANKS = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        solid = text.strip(BLANKS)
        found.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Dijkstra over (rows done, role initials so far, shortened to their last two), in the order of (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, kept, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", kept):
            return cost, audit, turns
        state = (i, kept[-1:], bool(kept))
        if state in done:
            continue
        done.add(state)
        ways = [(2, "I", r, (r, ""), 0) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            ways.append((3, "D", "", None, 1))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                ways += [(0 + more, "K", role, (role, text), 1), *[(2 + more, "R", r, (r, text), 1) for r in ("user", "assistant")]]
        for price, edit, role, turn, step in ways:
            after = kept + role[:1]
            if turn is None or role and re.fullmatch("s?(ua)*u?", after):
                heapq.heappush(heap, (cost + price, audit + edit, i + step, after, turns + ((turn,) if turn else ())))
    raise AssertionError


def plain(rows, original):
    out = {}
    for c in {r[0] for r in original}:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        talk = [(r[2], r[3]) for r in mine]
        found = faults(talk)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        cost, audit, kept = cheapest(talk, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[c] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)
    return out


def talks(seed, n, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        c = None if c == 3 else c * 7
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.03 else t + (rng.random() < 0.1) * 2
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice([None, "", "tool", "Upper", "system"]) if rng.random() < 0.08 else role
            text = rng.choice(["Well.", "No end", "Yes! ", "a.\n", "", None, " \t", "long " * 30 + "?", "same.", "é…"])
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return [*rows, rows[0], rows[0]]


SCHEMA = "conv_id long, turn long, role string, text string, copies int, kind string, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def repaired(rows):
    return {r["conv_id"]: tuple(r)[1:] for r in conv.repair_conversations(rows).collect()}


def test_every_edit_sequence_of_short_conversations():
    """The matrices against all edits of up to three rows, with up to two inserts at each place."""
    inserts = ["", "u", "a", "ua", "au"]
    for symbols in itertools.chain.from_iterable(itertools.product("suaoUX", repeat=n) for n in range(4)):
        least = None
        for gaps in itertools.product(inserts, repeat=len(symbols) + 1):
            for edits in itertools.product("DKua", repeat=len(symbols)):
                if any(s == "X" and e != "D" for s, e in zip(symbols, edits, strict=True)):
                    continue
                kept, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
                for s, e, gap in zip(symbols, edits, gaps[1:], strict=True):
                    kept += ("" if e == "D" else s.lower() if e == "K" else e) + gap
                    audit += (e if e in "DK" else "R") + "I" * len(gap)
                    cost += {"D": 3, "K": 0}.get(e, 2) + (s == "U" and e != "D") + 2 * len(gap)
                if re.fullmatch("(s?(ua)+)?", kept) and (least is None or (cost, audit) < least):
                    least = cost, audit
        parts = [[e for row in conv.row_matrix(s) for e in row] for s in symbols]
        assert conv._chain([([e and e[0] for e in m], [e and str(e[1]) for e in m]) for m in parts]) == least


@pytest.mark.parametrize(("seed", "longest", "segment"), [(1, 8, 256), (2, 40, 5)])
def test_repair_against_shortest_paths(spark, monkeypatch, seed, longest, segment):
    monkeypatch.setattr(conv, "SEGMENT", segment)
    rows = talks(seed, 40, longest)
    assert repaired(conv.damage(table(spark, rows))) == plain(damaged(rows), rows)


def test_repaired_turns_hash_to_the_digest(spark):
    rows = conv.damage(table(spark, talks(5, 20, 8)))
    lines = {}
    for r in sorted(conv.repaired_turns(rows).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, figures in repaired(rows).items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == figures[-1]


def test_no_rows_left_no_rows_at_all_and_very_many_copies(spark):
    none = repaired(spark.createDataFrame([(1, 1, "user", "x.", 0), (2, 1, "user", "x.", 1000), (2, 2, "assistant", "y.", 1)], "conv_id long, turn long, role string, text string, copies int"))
    assert none[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert none[2][2] == 999 and none[2][5:7] == (2997, "K" + "D" * 999 + "K")
    assert conv.repair_conversations(conv.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    named = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Yes.")], "conv_id string, turn long, role string, text string")
    assert [r["audit"] for r in conv.repair_conversations(named.selectExpr("*", "1 AS copies")).collect()] == ["KK"]


def test_grammar_gives_the_sequences_back(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choice("suaUAX") for _ in range(rng.randint(1, 60))) for _ in range(200)} | {"ua" * 120, "u" * 97}
    packed, rules = conv.compress(spark.createDataFrame([(t, len(t)) for t in texts], "seq string, n long"))
    meaning = {}
    for symbol, first, second in rules:
        meaning[symbol] = meaning.get(first, first) + meaning.get(second, second)
    found = packed.collect()
    assert {r["seq"] for r in found} == texts and all("".join(meaning.get(c, c) for c in r["packed"]) == r["seq"] for r in found)
    assert len(rules) > 10 and sum(len(r["packed"]) for r in found) < 0.6 * sum(map(len, texts))
