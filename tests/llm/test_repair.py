"""Conversation repair against a search over all edits that keeps whole strings of letters."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from courtside.llm import queries, repair

from ..conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, n string, block long, audit string"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def _cheapest(turns):
    """turns: (letter, must go, truncated). (cost, letters) by a search over (turn, state) with the best string of each, an edit at a time."""
    best = {(0, ""): (0, "")}
    done = []
    todo = [(0, "", 0, "")]
    import heapq

    while todo:
        cost, audit, at, state = heapq.heappop(todo)
        if best.get((at, state), (cost, audit)) < (cost, audit):
            continue
        if at == len(turns) and state in ("", "a"):
            done.append((cost, audit))
        ways = [(2, "I", 0, r) for r in "ua"]
        if at < len(turns):
            letter, gone, cut = turns[at]
            ways.append((3, "D", 1, None))
            if not gone:
                ways += [(2 + cut, "R", 1, r) for r in "ua"] + [(cut, "K", 1, letter)]
        for more, edit, step, role in ways:
            to = state if role is None else GRAMMAR.get((state, role))
            if to is None:
                continue
            new, key = (cost + more, audit + edit), (at + step, to)
            # letters of the same turns and cost are compared as strings; equal turns' strings are no prefixes of one another but for Inserts, which cost
            if key not in best or new < best[key]:
                best[key] = new
                heapq.heappush(todo, (*new, *key))
    return min(done)


def _exhaustive(turns, most):
    """All edit strings up to a length, for short conversations."""
    found = []

    def go(at, state, cost, audit):
        if at == len(turns) and state in ("", "a"):
            found.append((cost, audit))
        if len(audit) == most:
            return
        for r in "ua":
            if (state, r) in GRAMMAR:
                go(at, GRAMMAR[state, r], cost + 2, audit + "I")
        if at < len(turns):
            letter, gone, cut = turns[at]
            go(at + 1, state, cost + 3, audit + "D")
            if not gone:
                for edit, r, c in [("K", letter, 0), ("R", "u", 2), ("R", "a", 2)]:
                    if (state, r) in GRAMMAR:
                        go(at + 1, GRAMMAR[state, r], cost + c + cut, audit + edit)

    go(0, "", 0, "")
    return min(found)


def _turns(rng, n):
    return [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def _codes(turns):
    return [("sua".find(x) % 4) + 4 * gone + 8 * (cut and not gone) for x, gone, cut in turns]


def _audit(codes, size):
    """In blocks of `size` turns, as Spark deals them."""
    blocks = [codes[k : k + size] for k in range(0, len(codes), size)]
    found = []
    for b in blocks:
        vectors = [repair.forward(b, s) for s in range(4)]
        found.append((sum((c for c, _ in vectors), []), sum((r for _, r in vectors), [])))
    ends, cost, tail = repair.crossings(found)
    return cost, "".join("".join(repair.letters(b, s, e)) for b, s, e in zip(blocks, [0, *ends], ends)) + "I" * tail


def test_letters_equal_every_edit_string():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(x, gone, cut and not gone) for x, gone, cut in _turns(rng, rng.randint(1, 4))]
        assert _audit(_codes(turns), rng.randint(1, 4)) == _exhaustive(turns, 8), turns


def test_letters_equal_search():
    rng = random.Random(2)
    for _ in range(400):
        turns = [(x, gone, cut and not gone) for x, gone, cut in _turns(rng, rng.randint(1, 60))]
        assert _audit(_codes(turns), rng.choice([1, 2, 5, 16, 100])) == _cheapest(turns), turns


def _report(rows):
    """From the definition, row by row. rows: conv_id, turn, role, text."""
    out, own = {}, defaultdict(list)
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        out[conv] = None
        role, text, kind = blank(role), blank(text), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        said, faults, turns = set(), [], []
        ordered = sorted(own[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        for _, role, text in ordered:
            rest = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not rest else "duplicate" if (role, text) in said else "truncated" if rest[-1] not in ".!?" else None)
            said.add((role, text))
            turns.append((role[:1] or "x", faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = _cheapest(turns) if turns else (0, "")
        numbers = [t for t, _, _ in ordered if t is not None]
        state, lines, at = "", [], 0
        for edit in audit:
            if edit in "IR":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + (ordered[at][2] if edit == "R" else ""))
            elif edit == "K":
                state = ordered[at][1][0]
                lines.append(f"{ordered[at][1]}:{ordered[at][2]}")
            at += edit != "I"
        letters = [t[0] for t in turns]
        out[conv] = {
            "conv_id": conv, "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def _hard(rng):
    texts = ["So it is.", "Is it?", "cut", "", " \t", None, "No!  ", "x.\n"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in [None, *range(30)] for _ in range(rng.randint(0, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"Turn {t % 37}." if t % 5 else "cut") for t in range(700)] + rows[:6]
    return rows


def test_report_equals_definition(spark):
    rows = _hard(random.Random(3))
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA)
    want = _report(rows)
    for bits in (3, repair.BLOCK_BITS):
        got = {r.conv_id: r.asDict() for r in repair.report(docs, bits).collect()}
        assert got == want


def test_query_equals_definition(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {r.conv_id: r.asDict() for r in queries.op12_repair(spark, SMALL).collect()} == _report([tuple(r) for r in rows])


def test_empty(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("start", range(4))
def test_forward_and_backward_agree(start):
    codes = _codes([(x, gone, cut and not gone) for x, gone, cut in _turns(random.Random(start), 40)])
    cost, _ = repair.forward(codes, start)
    assert [repair.backward(codes, end)[start] for end in range(4)] == cost
