"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from turnmill.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, copies2 long, `conv` string, `cost` int"


def search(rows):
    """(cost, audit, repaired roles) by best-first search: nothing is merged, only what can end well is followed."""
    start = re.compile(r"(s?(ua)*u?)?")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, lines
        steps = [("I", 2, i, x, {"u": "user", "a": "assistant"}[x] + ":") for x in "ua"] if audit[-2:] != "II" else []
        if i < len(rows):
            role, text, bad, cut = rows[i]
            steps.append(("D", 3, i + 1, "", None))
            if not bad:
                steps += [("K", cut, i + 1, role[:1] or "?", f"{role}:{text}"), ("R", 2 + cut, i + 1, "u", f"user:{text}"), ("R", 2 + cut, i + 1, "a", f"assistant:{text}")]
        for letter, price, at, x, line in steps:
            if start.fullmatch(roles + x):
                heapq.heappush(heap, (cost + price, audit + letter, at, roles + x, lines if line is None else (*lines, line)))


def brute(rows, damaged):
    """The contract, row by row, over (conv, turn, role, text)."""
    out, by = Counter(), defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = by[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, parsed = set(), Counter(), []
        for _, role, text in mine:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            parsed.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(parsed, parsed[1:]))
        known = [t for t, *_ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = search(parsed)
        out[(conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


def made(rng, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User", "sudo", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "go!\n", " ", "", None, "ü.𝔘", "end. \t", "x" + str(rng.randrange(3))])
            rows.append((conv, rng.choice([turn, turn, turn + 3, 1, None]), role, text))
    return rows


def test_parser_equals_a_search_over_all_edits():
    rng = random.Random(11)
    for _ in range(400):
        rows = [(rng.choice("usaaut"), f"t{i}", rng.random() < 0.25, int(rng.random() < 0.3)) for i in range(rng.randrange(7))]
        cost, audit = turns.best_end(turns.parse([(r, bool(bad), bool(cut), 1) for r, _, bad, cut in rows]))
        assert (cost, audit) == search(rows)[:2], rows


def test_stretches_combine_to_the_whole():
    rng = random.Random(12)
    for _ in range(100):
        rows = [(rng.choice("usaau"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 1, 2, 5])) for _ in range(40)]
        tops = turns.parse([])
        cuts = sorted({0, 40, *(rng.randrange(40) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            after = {}
            for entry, (cost, audit) in tops.items():
                for to, (more, letters) in turns.parse(rows[a:b], entry).items():
                    turns._offer(after, to, cost + more, audit + letters)
            tops = after
        single = [(r, bad or i > 0, cut, 1) for r, bad, cut, n in rows for i in range(n)]
        assert turns.best_end(tops) == turns.best_end(turns.parse(rows)) == turns.best_end(turns.parse(single))


def test_another_grammar():
    table = turns.RoleTable([("talk", ()), ("talk", ("lines",)), ("lines", ("lines", "line")), ("lines", ("line",)), ("line", ("a", "b", "c"))])
    tops = {0}
    for symbol in "abcabc":
        tops = set().union(*(table.moves[t].get(symbol, ()) for t in tops))
    assert tops & table.ends and not table.moves[0].get("b")


@pytest.mark.parametrize("damaged", [False, True])
@pytest.mark.parametrize("bounds", [{}, {"long_rows": 2, "stretch": 2}])
def test_equals_brute_force(spark, damaged, bounds):
    rng = random.Random(13)
    rows = made(rng, [*range(60), None, None, -5], 7)
    rows += rows[:20] + [(1000, 5, "user", "only?"), (1001, 1, "user", "x" * 100_000 + "."), (1001, 2, "assistant", "ok.")]
    frame = spark.createDataFrame([(*r, 7, "c", 1) for r in rows], SCHEMA).repartition(5)
    source, copies = (turns.damage(frame), "copies") if damaged else (frame, None)
    found = turns.repair_conversations(source, copies_col=copies, **bounds)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, found.collect())) == brute(rows, damaged)


def test_repaired_rows_come_out(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (1, 3, "user", "Hi"), (2, 1, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for bounds in ({}, {"long_rows": 0}):
        got = {r.conv_id: r for r in turns.repair_conversations(frame, with_text=True, **bounds).collect()}
        assert (got[1].audit, got[1].cost, got[1].repaired) == ("IKDD", 8, "user:\nassistant:Hello.")
        assert (got[2].audit, got[2].repaired) == ("D", "")


def test_one_conversation_of_most_rows_is_parsed_by_many_tasks(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(30_000)] + [(9, 7, "user", "again.")] * 30_000 + [(i, 0, "user", "a.") for i in range(50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in turns.repair_conversations(frame, long_rows=1_000).collect()}
    assert len(got) == 50 and got[9].duplicate == 29_999 and got[9].audit.count("D") >= 29_999 and got[0].audit == "KI"


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.repair_conversations(none).count() == 0 and turns.damage(none).count() == 0
