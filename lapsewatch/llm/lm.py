"""A log-bilinear language model over word classes, trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. The most frequent tokens are classes of their
own, the others share classes by their ending and the mark behind it. The model predicts a class
from the two classes before it: the context vector is the sum of their feature vectors, each
weighted by position, and a class's score is its product with the class's target vector plus a
bias. A token's probability is that of its class, normalised by one matrix product over all
contexts, times the token's smoothed share of its class; an unseen token is one more outcome of
each class. So probabilities add up to one over all tokens and the unseen.

Counts of words and of class triples are gathered from all training texts. Training runs in
rounds: every task draws triples of its share by their counts, takes steps in numpy against noise
from the class frequencies, and the rounds average the parameters, a few kilobytes a task.

Texts that are null or empty are one end. Without training texts all probabilities are uniform.
Repeated rows are scored each on its own. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, partitions, pieces_of, words, written

#: Classes: the end, frequent words, and endings (the last of them for all other endings).
HEADS, FORMS = 95, 96
CLASSES = 1 + HEADS + FORMS
WIDE = CLASSES + 1  # classes that may stand before a token: one more for the start
SIZE = 32
#: Words that every task knows; the other words' counts are joined.
KNOWN = 200_000
ROUNDS, STEPS, BATCH, NOISE = 5, 120, 2048, 64
#: Tokens of a task for each step of a round beyond the least STEPS: draws grow with the corpus.
PACE = 32_768
MARKS = b".,;:!?%$&#*)\"'"
END = ""


def form(word: bytes) -> bytes:
    """The last two letters of a word, and the mark behind it."""
    core = word.rstrip(MARKS)
    tail = word[len(core):len(core) + 1]
    letters = core.decode("utf-8", "replace")[-2:]
    return letters.encode() + b"|" + tail


@dataclass
class Vocabulary:
    """Classes of words, and what is known of the frequent ones."""

    heads: dict[bytes, int]
    forms: dict[bytes, int]

    def class_of(self, word: bytes) -> int:
        found = self.heads.get(word)
        return found if found is not None else self.forms.get(form(word), CLASSES - 1)


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """word, c: how often each word, and the end as an empty word, occurs."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for piece in pieces_of(batch):
            for t in piece.column(0).to_pylist():
                counts.update(words(t))
        counts[b""] += batch.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()),
             pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return by_batch(texts.select(text), work, "word string, c bigint").groupBy("word").agg(
        F.sum("c").alias("c"))


def most_frequent(counts: DataFrame) -> list:
    """As many of the most frequent words as fit ``KNOWN``: all from some frequency on.

    Where to cut is read off a histogram of eight classes a doubling, so no task and no partition
    gives up more rows than are wanted in the end.
    """
    size = F.floor(F.log2("c") * 8).cast("int")
    held, cut = 0, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if held + r["count"] > KNOWN:
            break
        held, cut = held + r["count"], r["size"]
    return counts.where(size >= cut).orderBy(F.desc("c"), "word").collect() if held else []


def choose_classes(counts: DataFrame) -> Vocabulary:
    """Frequent words and endings; at most as many rows as there are classes reach the driver."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(HEADS).collect()
    heads = {b"": 0} | {r.word.encode(): i + 1 for i, r in enumerate(top)}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word.encode() not in heads:
                found[form(word.encode())] += c
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()),
                                           pa.array(list(found.values()), pa.int64())], ["form", "c"])

    ends = (by_batch(counts, work, "form binary, c bigint").groupBy("form").agg(F.sum("c").alias("c"))
            .orderBy(F.desc("c"), "form").limit(FORMS - 1).collect())
    return Vocabulary(heads, {bytes(r.form): 1 + HEADS + i for i, r in enumerate(ends)})


def class_sizes(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each class."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = np.array([vocabulary.class_of(w.encode()) for w in batch.column(0).to_pylist()], np.int64)
        c = batch.column(1).to_numpy()
        tokens = np.bincount(of, c, CLASSES).astype(np.int64)
        kinds = np.bincount(of, minlength=CLASSES)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(kinds)],
                                          ["of", "tokens", "kinds"])

    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_batch(counts, work, "of bigint, tokens bigint, kinds bigint").groupBy("of").agg(
            F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect():
        tokens[r["of"]], kinds[r["of"]] = r.tokens, r.kinds
    return tokens, kinds


class Classes(dict):
    """Classes of words, worked out on first sight; a full memory starts anew."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self.vocabulary.class_of(word)
        if len(word) <= 64:
            self[word] = found
        return found


def contexts(of: np.ndarray) -> np.ndarray:
    """Number of the context of each class: the two before it, starts where there are none."""
    before = np.concatenate([[CLASSES, CLASSES], of])
    return before[:-2] * WIDE + before[1:-1]


def count_triples(texts: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """context, of, n: how often each class follows each context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Classes(vocabulary)
        codes: list[np.ndarray] = []
        held = 0
        total, number = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(codes), return_counts=True)
            both, at = np.unique(np.concatenate([total, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([number, n])).astype(np.int64)

        for batch in batches:
            for piece in pieces_of(batch):
                for t in piece.column(0).to_pylist():
                    of = np.fromiter(map(look.__getitem__, [*words(t), b""]), np.int64)
                    codes.append(contexts(of) * CLASSES + of)
                    held += len(of)
                if held > 2_000_000:
                    total, number = merge()
                    codes, held = [], 0
        if codes:
            total, number = merge()
        for start in range(0, len(total), 100_000):
            part, n = total[start:start + 100_000], number[start:start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part // CLASSES), pa.array((part % CLASSES).astype(np.int32)), pa.array(n)],
                ["context", "of", "n"])

    return texts.select(text).mapInArrow(run, "context bigint, of int, n bigint").groupBy("context", "of").agg(
        F.sum("n").alias("n"))


@dataclass
class Parameters:
    """Feature vectors of what stands before, weights of positions, target vectors and biases."""

    features: np.ndarray
    position: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(frequency: np.ndarray, seed: int = 5) -> Parameters:
        random = np.random.default_rng(seed)
        return Parameters(random.normal(0, 0.1, (WIDE, SIZE)), np.ones((2, SIZE)),
                          random.normal(0, 0.1, (CLASSES, SIZE)), np.log(frequency))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.features, self.position, self.targets, self.bias)])

    @staticmethod
    def shaped(flat: np.ndarray) -> Parameters:
        cuts = np.cumsum([WIDE * SIZE, 2 * SIZE, CLASSES * SIZE])
        a, b, c, d = np.split(flat, cuts)
        return Parameters(a.reshape(WIDE, SIZE), b.reshape(2, SIZE), c.reshape(CLASSES, SIZE), d)

    def log_table(self) -> np.ndarray:
        """Log10 probabilities of every class after every context, one row per context."""
        far, near = np.divmod(np.arange(WIDE * WIDE), WIDE)
        out = np.empty((WIDE * WIDE, CLASSES), np.float32)
        for start in range(0, len(far), 4096):
            at = slice(start, start + 4096)
            q = self.position[0] * self.features[far[at]] + self.position[1] * self.features[near[at]]
            score = q @ self.targets.T + self.bias
            score -= score.max(axis=1, keepdims=True)
            score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
            out[at] = score / np.log(10)
        return out


def steps_of(tokens: float) -> int:
    """Steps of a round for a share of so many tokens."""
    return max(STEPS, math.ceil(tokens / PACE))


def train_share(start: np.ndarray, context: np.ndarray, of: np.ndarray, n: np.ndarray,
                noise: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Parameters after steps on triples drawn by their counts, each against shared noise.

    The chance that a class came from the data and not from ``NOISE`` draws of the noise is the
    sigmoid of its score less the log of NOISE times its noise probability.
    """
    p = Parameters.shaped(start.copy())
    random = np.random.default_rng(seed)
    ends, draw = np.cumsum(n), np.cumsum(noise)
    shift = np.log(NOISE * noise)
    seen = [np.full(x.shape, 1e-6) for x in (p.features, p.position, p.targets, p.bias)]

    def step(i: int, x: np.ndarray, slope: np.ndarray) -> None:
        seen[i] += slope * slope
        x += rate * slope / np.sqrt(seen[i])

    for _ in range(steps_of(ends[-1])):
        at = np.searchsorted(ends, random.random(BATCH) * ends[-1], "right").clip(max=len(n) - 1)
        far, near = np.divmod(context[at], WIDE)
        true = of[at]
        other = np.searchsorted(draw, random.random(NOISE) * draw[-1], "right").clip(max=CLASSES - 1)
        u, v = p.features[far], p.features[near]
        q = p.position[0] * u + p.position[1] * v
        good = (q * p.targets[true]).sum(1) + p.bias[true] - shift[true]
        bad = q @ p.targets[other].T + p.bias[other] - shift[other]
        pull = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        slope_q = pull[:, None] * p.targets[true] + push @ p.targets[other]
        targets, bias = np.zeros_like(p.targets), np.zeros_like(p.bias)
        order = np.argsort(true, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(true[order]) > 0])
        targets[true[order][first]] = np.add.reduceat((pull[:, None] * q)[order], first)
        np.add.at(targets, other, push.T @ q)
        bias += np.bincount(true, pull, CLASSES) + np.bincount(other, push.sum(0), CLASSES)
        features = np.zeros_like(p.features)
        for place, rows in ((0, far), (1, near)):
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
            features[rows[order][first]] += np.add.reduceat((slope_q * p.position[place])[order], first)
        position = np.stack([(slope_q * u).sum(0), (slope_q * v).sum(0)])
        for i, (x, slope) in enumerate(((p.features, features), (p.position, position),
                                        (p.targets, targets), (p.bias, bias))):
            step(i, x, slope / BATCH)
    return p.flat()


def train(triples: DataFrame, frequency: np.ndarray) -> Parameters:
    """Rounds of steps in every task, from and to averaged parameters."""
    flat = Parameters.fresh(frequency).flat()
    shares = max(2, partitions(triples.sparkSession))
    spread = written(triples.repartition(shares, "context"), "triples")
    for turn in range(ROUNDS):
        start, rate = flat, 0.1 / (1 + turn) ** 0.5

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [f for f in frames if len(f)]
            if rows:
                held = pd.concat(rows)
                n = held["n"].to_numpy(float)
                out = train_share(start, held["context"].to_numpy(), held["of"].to_numpy(), n, frequency,
                                  int(held["context"].iloc[0]) + turn, rate)
                yield pd.DataFrame({"at": np.arange(len(out)), "total": out * n.sum(), "weight": n.sum()})

        parts = spread.mapInPandas(run, "at long, total double, weight double")
        mean = parts.groupBy("at").agg((F.sum("total") / F.sum("weight")).alias("mean")).collect()
        if not mean:
            break
        flat = np.zeros(len(flat))
        for r in mean:  # as many rows as there are parameters
            flat[r["at"]] = r["mean"]
    return Parameters.shaped(flat)


def score(df: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """One row per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held"))
    learned = texts.where(~F.col("held")).select("text")
    counts = written(count_words(learned, "text"), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    vocabulary = choose_classes(counts)
    tokens, kinds = class_sizes(counts, vocabulary)
    frequency = (tokens + 0.5) / (tokens + 0.5).sum()
    model = train(count_triples(learned, "text", vocabulary), frequency)
    flat = model.flat().astype(np.float32)
    base_all = np.log10(total.n + 0.5 * (total.v + 1))
    # A class of one word has no other outcome; the others have one more for the unseen.
    single = np.arange(CLASSES) <= HEADS
    room = np.where(single, 0.0, np.log10(tokens + 0.5 * (kinds + 1)))
    frequent = most_frequent(counts)
    shared = spark.sparkContext.broadcast(([r.word.encode() for r in frequent],
                                           np.array([r.c for r in frequent], np.int64), flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, packed = shared.value
        of_known = np.array([vocabulary.class_of(w) for w in known], np.int64)
        base_known = np.log10(c + 0.5) - base_all if len(c) else np.zeros(0)
        share_known = np.where(single[of_known], 0.0, np.log10(c + 0.5) - room[of_known])
        place = {w: i for i, w in enumerate(known)}
        log = Parameters.shaped(packed.astype(np.float64)).log_table().ravel()
        look, absent = Classes(vocabulary), len(known)
        for batch in batches:
            for piece in pieces_of(batch):
                rows, out = piece.column(0).to_pylist(), []
                rare_row, rare_word, rare_of, rare_n = [], [], [], []
                for row, t in zip(rows, piece.column(2).to_pylist()):
                    found = [*words(t), b""]
                    at = np.fromiter([place.get(w, absent) for w in found], np.int64, len(found))
                    seen = at < absent
                    of = np.empty(len(at), np.int64)
                    of[seen] = of_known[at[seen]]
                    rest = [found[i] for i in np.flatnonzero(~seen)]
                    of[~seen] = [look[w] for w in rest]
                    value = log[contexts(of) * CLASSES + of].sum(dtype=np.float64)
                    out.append((len(found), int(seen.sum()), float(base_known[at[seen]].sum()),
                                float(value + share_known[at[seen]].sum())))
                    if rest:
                        distinct = Counter(rest)
                        rare_row += [row] * len(distinct)
                        rare_word += distinct
                        rare_of += [look[w] for w in distinct]
                        rare_n += distinct.values()
                n, blank = len(rows), len(rare_row)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows + rare_row, pa.int64()),
                     pa.concat_arrays([piece.column(1), pa.nulls(blank, piece.column(1).type)]),
                     pa.concat_arrays([piece.column(3), pa.nulls(blank, pa.bool_())]),
                     pa.array([*columns[0], *rare_n], pa.int64()),
                     pa.array([*columns[1], *rare_of], pa.int64()),
                     pa.array([*columns[2], *[None] * blank], pa.float64()),
                     pa.array([*columns[3], *[None] * blank], pa.float64()),
                     pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(rare_word, pa.binary()).cast(pa.string())])],
                    ["row", "key", "held", "n", "k", "base", "score", "word"])

    kind = df.schema[key].dataType.simpleString()
    # Row numbers hold for this one pass, whose result is written before it is split.
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held"))
    parts = written(numbered.mapInArrow(run, f"row bigint, key {kind}, held boolean, n bigint, k bigint, "
                                             "base double, score double, word string"), "scores")
    rare = parts.where("word is not null").select("row", "word", "n", F.col("k").alias("of"))
    rooms = F.element_at(F.array(*[F.lit(float(r)) for r in room]), F.col("of").cast("int") + 1)
    seen = F.coalesce("c", F.lit(0))
    joined = rare.join(counts, "word", "left").select(
        "row", F.when(seen > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * (F.log10(seen + 0.5) - F.lit(float(base_all)))).alias("more_base"),
        F.when(F.col("of") <= HEADS, 0.0).otherwise(
            F.col("n") * (F.log10(seen + 0.5) - rooms)).alias("more"))
    extra = joined.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "more_base", "more")])
    whole = parts.where("word is null").join(extra, "row", "left")
    return whole.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("k") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
