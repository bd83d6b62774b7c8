"""Conversation repair against a plain search: faults, costs, least audits and repaired text."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lapsewatch.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, symbol string"
PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}


def hurt(rows):
    """The rows of one conversation after damage, as (turn, role, text) in order."""
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                      hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def step(state, initial):
    """States are the initials so far, as far as they matter: start, s, u, a."""
    return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)


def cheapest(rows, wrong):
    """Row by row: the best (cost, audit, lines) for each state, insertions of one turn at a time."""
    def insert(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for x in "ua":
                    put(best, step(state, x), (cost + 5, audit + "I", lines + [f"{ROLES[x]}:"]))
        return best

    def put(best, state, entry):
        if state is not None and (state not in best or entry[:2] < best[state][:2]):
            best[state] = entry

    best = insert({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, wrong):
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + 2, audit + "D", lines))
            if fault not in ("b", "d"):
                cut = 5 * (fault == "t")
                for x in "ua":
                    put(new, step(state, x), (cost + cut + 1, audit + "R", lines + [f"{ROLES[x]}:{text}"]))
                put(new, step(state, role[:1]), (cost + cut, audit + "K", lines + [f"{role}:{text}"]))
        best = insert(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    """conv_id -> the row that must come out."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row[:4])
    out = {}
    for conv, mine in groups.items():
        after = hurt(mine)
        wrong = faults(after)
        turns = {r[0] for r in after if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        starts = [r[1][:1] for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        cost, audit, lines = cheapest(after, wrong)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, wrong.count("b"), wrong.count("d"), wrong.count("t"), illegal, cost, audit, digest)
    return out


def compare(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    got = repair.repair(df).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def made(seed, conversations, longest):
    draw = random.Random(seed)
    texts = ["yes.", "no!", "maybe", "why?", " ", "", None, "é.\n", "a.b", "end. \t", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "super"]
    rows = []
    for conv in range(conversations):
        turn = draw.randint(-3, 5)
        for _ in range(draw.randint(1, longest)):
            turn += draw.choice([0, 1, 1, 1, 1, 2])
            rows.append((conv if conv else None, None if draw.random() < 0.03 else turn,
                         draw.choice(roles), draw.choice(texts)))
    return rows + draw.sample(rows, 20)


def test_random_conversations(spark):
    compare(spark, made(4, 150, 12))


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    compare(spark, rows)


def test_short_audits_by_exhaustion():
    """The plain search itself against every audit with up to two insertions."""
    import itertools

    for kinds in itertools.product(["ub", "u", "ut", "a", "at", "s"], repeat=3):
        rows = [(0, {"u": "user", "a": "assistant", "s": "system"}[k[0]], "") for k in kinds]
        wrong = [k[1:] for k in kinds]
        best = None
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=4):
            if sum(map(len, gaps)) > 3:
                continue
            for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=3):
                if any(w == "b" and e != "D" for w, e in zip(wrong, edits)):
                    continue
                made_, cost, audit = gaps[0], 5 * sum(map(len, gaps)), "I" * len(gaps[0])
                for (_, role, _), w, e, gap in zip(rows, wrong, edits, gaps[1:]):
                    made_ += ("" if e == "D" else role[0] if e == "K" else e[1]) + gap
                    cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (w == "t" and e != "D")
                    audit += e[0] + "I" * len(gap)
                if PATTERN.fullmatch(made_):
                    best = min(best or (99, ""), (cost, audit))
        assert cheapest(rows, wrong)[:2] == best, kinds


def test_long_conversation_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    draw = random.Random(8)
    rows = [(7, t // 2, draw.choice(["user", "assistant"]), f"w{draw.randint(0, 300)}{draw.choice('.?-')}")
            for t in range(1500)]
    rows += [(8, 3, "user", "again.")] * 90 + [(9, None, "user", "x.")] * 3 + [(10, 5, "system", "only.")]
    compare(spark, rows, parts=7)


def test_grammar_shares_rules_and_changes_nothing(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in made(5, 80, 10)], SCHEMA)
    parts = repair.segments(repair.symbols_of(repair.damage(df))).cache()
    grammar = repair.learn(parts)
    assert len(grammar.rules) > 10
    bare = repair.Grammar([])
    for r in parts.where("length(symbols) > 0").select("symbols").distinct().collect():
        symbols = bytes(r.symbols)
        spelled = grammar.encode(list(symbols))

        def spell(s):
            return [s] if s < repair.SYMBOLS else [x for y in grammar.rules[s - repair.SYMBOLS] for x in spell(y)]
        assert [x for s in spelled for x in spell(s)] == list(symbols)
        shown = [[e and (e[0], str(e[1])) for e in g.matrix(symbols)] for g in (grammar, bare)]
        assert shown[0] == shown[1]
    parts.unpersist()


def test_ropes_compare_as_strings():
    draw = random.Random(3)
    for _ in range(400):
        strings = ["".join(draw.choice("DK") for _ in range(draw.randint(20, 60))) for _ in range(2)]
        strings[1] = draw.choice([strings[1], strings[0][:draw.randint(0, 20)] + strings[1], strings[0]])
        ropes = []
        for s in strings:
            parts = [repair.Rope(x) for x in s]
            while len(parts) > 1:
                at = draw.randrange(len(parts) - 1)
                parts[at:at + 2] = [repair.Rope(parts=(parts[at], parts[at + 1]))]
            ropes.append(parts[0] if parts else repair.Rope())
        assert str(ropes[0]) == strings[0] and ropes[0].before(ropes[1]) == (strings[0] < strings[1])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, 0, "user", "a" * 300_000)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()} == plain(rows)
