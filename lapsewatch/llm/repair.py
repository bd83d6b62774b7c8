"""Conversation structure repair: a grammar-compressed, tie-exact minimum-cost edit of turns.

Every row of a conversation is one of a few symbols (initial of its role, and its fault). Keeping,
re-roling, deleting and inserting around one row is a 4 x 4 matrix over (cost, audit) with minimum
and concatenation, between the states of the accepted pattern ``(s?(ua)+)?``. Matrices of adjacent
rows multiply associatively, so Re-Pair rules, found on the distinct symbol sequences of all
conversations, get one matrix each, evaluated bottom-up and shared by every conversation that holds
the rule. Audits are ropes: a product joins two shared ropes and copies no text, and ties are
settled by the first letter in which two ropes differ. No two audits of one cost between the same
states are prefixes of each other (a longer one has further insertions), so the least audit of a
product is the product of least audits.

Work on Spark: rows are damaged, then repeated rows are counted (map-side) and numbered by a range
sort of narrow rows, so that a conversation of any length is spread over tasks, in segments of at
most ``SEGMENT`` rows. Duplicates come from an aggregate, not from a window over a conversation.
Segments, not rows, meet per conversation. Only the final hash needs the texts of a conversation in
order in one task, which streams them; an audit is one string, as the contract asks.

Rows of one turn are ordered by role, then by the MD5 of role and text; null turns come first.
A null role or text reads as one space, and so do null keys in the damage hash; a null conv_id
is a conversation of its own. A role that is empty or begins with another letter than s, u, a has
no legal initial: it is re-roled or deleted. Repeated rows are damaged alike and count as often as
they occur. Conversations of which no row is left, and an empty table, are defined: zeros, an empty
audit and the hash of no bytes; no rows. Gaps too wide for a long are null. Only the named columns
are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import partitions, written

#: Rows of a conversation that one matrix product covers before segments meet.
SEGMENT = 4096
#: Rules of the grammar at most, and new rules at most per reading of the sequences. Both only set
#: how much work is shared: sequences without rules are multiplied symbol by symbol.
RULES, ROUND = 512, 64
#: Sequences whose product a worker remembers.
KNOWN = 20_000

ROLE_CODES = "sua?"
FAULTS = ("fine", "truncated")
#: Symbols: 0 a row that must go (blank or duplicate); 1 + 2 * role + fault otherwise.
SYMBOLS = 1 + len(ROLE_CODES) * len(FAULTS)
DELETE, KEEP, REROLE, INSERT, CUT = 2, 0, 1, 5, 5

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
        (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
NAMES = {"u": "user", "a": "assistant"}

BASE, MODULUS = 1_000_003, (1 << 61) - 1


class Rope:
    """A string as a tree of shared parts, with its length and a hash of its letters."""

    __slots__ = ("size", "code", "power", "parts", "text")

    def __init__(self, text: str = "", parts: tuple[Rope, Rope] | None = None):
        self.parts, self.text = parts, text
        if parts is None:
            self.size, self.code = len(text), 0
            for letter in text:
                self.code = (self.code * BASE + ord(letter)) % MODULUS
            self.power = pow(BASE, self.size, MODULUS)
        else:
            left, right = parts
            self.size = left.size + right.size
            self.code = (left.code * right.power + right.code) % MODULUS
            self.power = left.power * right.power % MODULUS

    def join(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= 16:
            return Rope(str(self) + str(other))
        return Rope(parts=(self, other))

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            rope = stack.pop()
            if rope.parts is None:
                yield rope.text
            else:
                stack += (rope.parts[1], rope.parts[0])

    def __str__(self) -> str:
        return "".join(self.leaves())

    def before(self, other: Rope) -> bool:
        """Whether this string is less; parts with one length and hash are taken as equal."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine[-1], theirs[-1]
            if a.size == b.size and a.code == b.code:
                mine.pop(), theirs.pop()
            elif a.parts is not None and (a.size >= b.size or b.parts is None):
                mine.pop()
                mine += (a.parts[1], a.parts[0])
            elif b.parts is not None:
                theirs.pop()
                theirs += (b.parts[1], b.parts[0])
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                mine.pop(), theirs.pop()
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    theirs.append(Rope(b.text[n:]))
        return bool(theirs)


Entry = tuple[int, Rope]
Matrix = list[Entry | None]


def better(new: Entry, old: Entry | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and new[1].before(old[1])


def product(left: Matrix, right: Matrix) -> Matrix:
    """Minimum over the state in between; ties go to the least audit."""
    out: Matrix = [None] * 16
    for p in range(4):
        for m in range(4):
            first = left[4 * p + m]
            if first is None:
                continue
            for q in range(4):
                second = right[4 * m + q]
                if second is None:
                    continue
                cost, held = first[0] + second[0], out[4 * p + q]
                if held is not None and cost > held[0]:
                    continue
                entry = (cost, first[1].join(second[1]))
                if better(entry, held):
                    out[4 * p + q] = entry
    return out


def insertions() -> Matrix:
    """Any number of inserted turns, the fewest that lead from state to state."""
    out: Matrix = [None] * 16
    for p in range(4):
        state, count = p, 0
        while out[4 * p + state] is None:
            out[4 * p + state] = (INSERT * count, Rope("I" * count))
            ways = [STEP[state, x] for x in "ua" if (state, x) in STEP]
            state, count = ways[0], count + 1
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """One edit of a row, then insertions."""
    edit: Matrix = [None] * 16
    for p in range(4):
        edit[4 * p + p] = (DELETE, Rope("D"))
        if symbol:
            role, cut = ROLE_CODES[(symbol - 1) // 2], CUT * ((symbol - 1) % 2)
            ways = [(REROLE + cut, "R", x) for x in "ua"] + [(KEEP + cut, "K", role)]
            for cost, letter, initial in ways:
                if (p, initial) in STEP:
                    at = 4 * p + STEP[p, initial]
                    if better((cost, Rope(letter)), edit[at]):
                        edit[at] = (cost, Rope(letter))
    return product(edit, insertions())


def replace(sequence: list[int], pair: tuple[int, int], name: int) -> list[int]:
    out, i, last = [], 0, len(sequence) - 1
    while i <= last:
        if i < last and sequence[i] == pair[0] and sequence[i + 1] == pair[1]:
            out.append(name)
            i += 2
        else:
            out.append(sequence[i])
            i += 1
    return out


@dataclass
class Grammar:
    """Rules in the order they were found; rule i is symbol SYMBOLS + i."""

    rules: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.matrices: list[Matrix] | None = None
        self.rank = {pair: i for i, pair in enumerate(self.rules)}
        self.known: dict[bytes, Matrix] = {}

    def __getstate__(self):
        return self.rules

    def __setstate__(self, rules):
        self.rules = rules
        self.__post_init__()

    def encode(self, sequence: list[int]) -> list[int]:
        """The sequence with every rule applied, earliest rule first."""
        while len(sequence) > 1:
            least = min((self.rank.get(pair, RULES) for pair in zip(sequence, sequence[1:])), default=RULES)
            if least == RULES:
                break
            sequence = replace(sequence, self.rules[least], SYMBOLS + least)
        return sequence

    def matrix(self, symbols: bytes) -> Matrix:
        """The transfer matrix of a segment: the product of its symbols' and rules' matrices."""
        if self.matrices is None:
            self.matrices = [symbol_matrix(s) for s in range(SYMBOLS)]
            for left, right in self.rules:
                self.matrices.append(product(self.matrices[left], self.matrices[right]))
        found = self.known.get(symbols)
        if found is None:
            parts = [self.matrices[s] for s in self.encode(list(symbols))]
            while len(parts) > 1:
                parts = [product(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                         for i in range(0, len(parts), 2)]
            found = parts[0]
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[symbols] = found
        return found


def pair_counts(sequences: DataFrame) -> DataFrame:
    """How often adjacent pairs occur, pairs of one symbol without overlap; counted in each task first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for code, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                taken = False
                for pair in zip(code, code[1:]):
                    taken = pair[0] == pair[1] and not taken
                    if taken or pair[0] != pair[1]:
                        total[pair] += times
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in total], pa.int32()), pa.array([p[1] for p in total], pa.int32()),
             pa.array(list(total.values()), pa.int64())], ["left", "right", "times"])

    return (sequences.mapInArrow(work, "left int, right int, times bigint")
            .groupBy("left", "right").agg(F.sum("times").alias("times")))


def learn(segments: DataFrame, most: int = RULES) -> Grammar:
    """Re-Pair over the distinct sequences, each weighted by its occurrences.

    A round takes the most frequent pairs, as long as no symbol is left in one of them and right in
    another, so that no two overlap and their order does not matter. It ends when no pair occurs
    twice or ``most`` rules are found.
    """
    found = (segments.where(F.length("symbols") > 1)
             .groupBy("symbols").agg(F.count(F.lit(1)).alias("times")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [list(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code, pa.list_(pa.int32())), batch.column(1)], ["code", "times"])

    sequences = written(found.mapInArrow(unpack, "code array<int>, times bigint"), "sequences")
    rules: list[tuple[int, int]] = []
    while len(rules) < most:
        top = (pair_counts(sequences).where("times > 1")
               .orderBy(F.desc("times"), "left", "right").limit(ROUND).collect())
        lefts: set[int] = set()
        rights: set[int] = set()
        new: list[tuple[int, int]] = []
        for r in top:
            alone = r.left == r.right and r.left in lefts | rights
            if r.left not in rights and r.right not in lefts and not alone and len(rules) + len(new) < most:
                lefts.add(r.left)
                rights.add(r.right)
                new.append((r.left, r.right))
        if not new:
            break
        sequences = written(_replaced(sequences, new, SYMBOLS + len(rules)), "sequences")
        rules += new
    return Grammar(rules)


def _replaced(sequences: DataFrame, pairs: list[tuple[int, int]], first: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for code in batch.column(0).to_pylist():
                for i, pair in enumerate(pairs):
                    code = replace(code, pair, first + i)
                codes.append(code)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.list_(pa.int32())), batch.column(1)], ["code", "times"])
    # A sequence of one symbol has no pairs any more.
    return sequences.mapInArrow(work, "code array<int>, times bigint").where(F.size("code") > 1)


def damage(df: DataFrame) -> DataFrame:
    """The rows after damage, each different row once with its number; 0: all were dropped.

    Copies are combined before the shuffle, so a row that repeats without end is one row.
    """
    def text_of(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    hurt = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), draw.alias("draw"), text_of("role").alias("role"), text_of("text").alias("text"))
    hurt = hurt.select(
        "conv_id", "turn",
        F.when(F.col("draw") == 0, "").when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("bigint").alias("copies"))
    return hurt.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


SPACE = r"\x20\x09-\x0D"


def symbols_of(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv_id, turn, order of ties, initial, symbol of the first copy, fault, copies."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ends = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    light = rows.select(
        "conv_id", "turn", "role", F.md5(F.concat("role", F.lit(":"), "text")).alias("mark"),
        F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~ends.isin(".", "!", "?")).alias("cut"), "copies")
    # Marks that occur in several turns, and the first of these.
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = (light.where("copies > 0 AND NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                                                             F.col("mark").alias("m"))
             .agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1"))
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")))
    joined = light.join(again, same, "left")
    late = F.col("turns").isNotNull() & ~F.col("blank") & (at != F.col("first"))
    code = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(
        F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("blank") | late, 0).otherwise(1 + 2 * code + F.col("cut").cast("int"))
    return joined.select(
        "conv_id", "turn", "role", "mark", code.cast("int").alias("code"), symbol.cast("int").alias("symbol"),
        F.col("blank").cast("int").alias("blank"), "copies")


SEGMENT_SCHEMA = ("conv_id bigint, place bigint, symbols binary, codes binary, blank bigint, duplicate bigint, "
                  "truncated bigint, turns bigint, low bigint, high bigint")


def segments(narrow: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT rows of one conversation, in order of ``place``.

    The rows are sorted by ranges over all tasks; a run ends with its conversation, task or size.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark"]
    ranged = narrow.repartitionByRange(partitions(narrow.sparkSession), *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        conv, held, turn = None, None, None

        def close() -> None:
            nonlocal place, held
            if held is not None:
                out.append((conv, place, bytes(held["s"]), bytes(held["c"]), held["b"], held["d"], held["t"],
                            held["n"], held["low"], held["high"]))
                place += 1
                held = None

        for batch in batches:
            for conv_id, at, _, _, code, symbol, blank, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and conv_id != conv:
                    close()
                if held is None or len(held["s"]) >= SEGMENT:
                    close()
                    conv, turn = conv_id, None
                    held = {"s": bytearray(), "c": bytearray(), "b": 0, "d": 0, "t": 0, "n": 0,
                            "low": None, "high": None}
                if not copies:
                    continue
                if at is not None:
                    if at != turn:
                        held["n"] += 1
                        turn = at
                    held["low"] = at if held["low"] is None else held["low"]
                    held["high"] = at
                while copies:
                    if len(held["s"]) >= SEGMENT:
                        close()
                        # A turn divided between segments is counted in both, once less where they meet.
                        held = {"s": bytearray(), "c": bytearray(), "b": 0, "d": 0, "t": 0,
                                "n": int(at is not None), "low": at, "high": at}
                    fit = min(copies, SEGMENT - len(held["s"]))
                    held["s"] += bytes([symbol]) + bytes(fit - 1)
                    held["c"] += bytes([code]) * fit
                    held["b"] += fit * blank
                    held["d"] += 0 if blank else fit - (symbol > 0)
                    held["t"] += symbol > 0 and (symbol - 1) % 2
                    symbol, copies = 0, copies - fit
                if len(out) >= 2048:
                    yield _segment_batch(out)
                    out.clear()
        close()
        yield _segment_batch(out)

    return ranged.mapInArrow(work, SEGMENT_SCHEMA)


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()] + [pa.int64()] * 6
    names = [part.split()[0] for part in SEGMENT_SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = {(0, 1), (1, 2), (2, 1)}


@dataclass
class Folded:
    """What is known of a conversation after some of its segments."""

    conv_id: int | None
    parts: list[Matrix] = field(default_factory=list)
    joined: int = 0
    sums: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    last: int | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, matrix: Matrix | None, codes: bytes, counts: list[int], turns: int,
            low: int | None, high: int | None) -> None:
        if codes:
            # As in a binary counter: products of equal lengths meet, so ropes stay balanced.
            self.parts.append(matrix)
            at = self.joined = self.joined + 1
            while at % 2 == 0:
                right, left = self.parts.pop(), self.parts.pop()
                self.parts.append(product(left, right))
                at //= 2
            line = np.frombuffer(codes, np.uint8)
            pairs = np.bincount(line[:-1].astype(int) * 4 + line[1:], minlength=16)
            good = sum(int(pairs[4 * a + b]) for a, b in LEGAL)
            self.illegal += len(line) - 1 - good
            if self.last is not None:
                self.illegal += (self.last, int(line[0])) not in LEGAL
            self.last = int(line[-1])
        self.sums = [a + b for a, b in zip(self.sums, counts)]
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = gaps if gaps < 1 << 63 else None
        if not self.parts:
            return (self.conv_id, gaps, *self.sums, self.illegal, 0, "")
        total = self.parts[-1]
        for left in reversed(self.parts[:-1]):
            total = product(left, total)
        total = product(insertions(), total)
        best = None
        for state in (START, AFTER_A):
            entry = total[4 * START + state]
            if entry is not None and better(entry, best):
                best = entry
        return (self.conv_id, gaps, *self.sums, self.illegal, best[0], str(best[1]))


def plans(parts: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per conversation: its counts, cost and audit, from its segments in order."""
    count = partitions(parts.sparkSession)
    dealt = parts.repartition(count, "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Folded | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv_id, _, symbols, codes, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Folded(conv_id)
                now.add(grammar.matrix(symbols) if symbols else None, codes, rest[:3], *rest[3:])
            yield _plan_batch(out)
            out.clear()
        if now is not None:
            yield _plan_batch([now.result()])

    return dealt.mapInArrow(work, PLAN)


def _plan_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.string())],
        [part.split()[0] for part in PLAN.split(", ")])


class Writer:
    """Applies an audit to the rows of a conversation as they come, line by line."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self.turn(), ""

    def turn(self) -> str:
        """The role of user or assistant that the pattern asks for next."""
        initial = "a" if self.state == AFTER_U else "u"
        self.state = STEP[self.state, initial]
        return NAMES[initial]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[0]]
            yield role, text
        elif edit == "R":
            yield self.turn(), text


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows with ``repaired_sha256``; texts are streamed in order, never gathered."""
    names = ["conv_id", "kind", "turn", "role", "mark", "text", "copies"]
    lines = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role",
        F.md5(F.concat("role", F.lit(":"), "text")).alias("mark"), "text", "copies")
    lines = lines.withColumns({name: F.lit(None).cast(kind) for name, kind in [
        (part.split()[0], part.split()[1]) for part in PLAN.split(", ")][1:]})
    heads = plan.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("bigint"), "role": F.lit(""),
                              "mark": F.lit(""), "text": F.lit(""), "copies": F.lit(0).cast("bigint")})
    counts = [part.split()[0] for part in PLAN.split(", ")][1:]
    both = heads.select(*names, *counts).unionByName(lines.select(*names, *counts))
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "mark"]
    dealt = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = writer = digest = None
        first, out = True, []

        def put(made: Iterator[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in made:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def close() -> None:
            if head is not None:
                put(writer.insertions())
                out.append((*head, digest.hexdigest()))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, kind, _, role, _, text, copies, *rest in zip(*columns):
                if kind == 0:
                    close()
                    head, writer, digest, first = (conv_id, *rest), Writer(rest[-1]), hashlib.sha256(), True
                else:
                    for _ in range(copies):
                        put(writer.row(role, text))
            yield _done_batch(out)
            out.clear()
        close()
        yield _done_batch(out)

    return dealt.mapInArrow(work, PLAN + ", repaired_sha256 string")


def _done_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 9
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.string()) for c in columns[7:]],
        [part.split()[0] for part in PLAN.split(", ")] + ["repaired_sha256"])


def repair(df: DataFrame) -> DataFrame:
    """Every conversation of conv_id, turn, role, text: its faults, cheapest repair and their hash."""
    rows = written(damage(df), "turns")
    parts = written(segments(symbols_of(rows)), "segments")
    plan = written(plans(parts, learn(parts)), "repairs")
    return repaired(rows, plan)
