"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata, and its context.

Words and word beginnings that stand out in documents labelled toxic make the lexicon; copies of
a document count once. A word of a text hits a term if it is the term, if it begins with a listed
beginning, or if the automaton of edit distance one (a letter added, dropped, changed or two
swapped) accepts a term of the trie. What stands around a hit decides how it counts: inside
quotation marks, or after a verb of speech, it is a quotation, else abuse. A logistic fit over
these counts gives the score.

Texts that are null, empty or without hits get the base rate. Only the text enters a score. The
fit takes at most about ``SAMPLE`` labelled rows, chosen by a hash of the key; without both
labels the score is 0.25 for all. Repeated rows are scored each on its own; columns
beyond the named ones are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, written

#: Labelled rows of the fit, about.
SAMPLE = 20_000
#: Terms of the lexicon at most, and share of the toxic documents that one must be seen in.
TERMS, SUPPORT, LEAST = 2000, 0.005, 4
#: Part of the documents with a term that must be toxic, for words and for beginnings.
SURE, SURE_START = 0.8, 0.9
STARTS = (4, 5, 6)
FUZZY_FROM, WINDOW = 5, 6
#: Words that a Python worker remembers the kind of.
KNOWN = 80_000
WORD = re.compile(r"[^\W_]+")
MARKS = "\"“”„«»"
# Fixed words after which, or near which, a term is somebody else's.
SPEECH = frozenset("said says wrote writes quote quoted called calls word term insult sagte schrieb "
                   "zitat wort dit écrit mot citation dijo escribió palabra cita".split())
LEET = str.maketrans("01345", "oieas")


class Trie:
    """Terms by letters; the empty key marks the end of one."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def within_one(self, word: str) -> bool:
        """Whether the automaton of ``word`` at distance one accepts a term of the trie.

        The automaton's state is the row of edit distances to the word's beginnings, of which
        only the three around the diagonal can be at most one.
        """
        n, far = len(word), 9
        stack = [(self.root, 0, far, 0, 1, "", far)]
        while stack:
            # low, mid, high: distances to the first depth - 1, depth, depth + 1 letters.
            node, depth, low, mid, high, last, before = stack.pop()
            if "" in node and (depth == n and mid <= 1 or depth == n - 1 and high <= 1
                               or depth == n + 1 and low <= 1):
                return True
            for letter, child in node.items():
                if not letter:
                    continue
                # Distances to the first depth, depth + 1 and depth + 2 letters, one deeper.
                a = min(mid + 1, low + (not 0 < depth <= n or word[depth - 1] != letter))
                b = c = far
                if depth < n:
                    b = min(mid + (word[depth] != letter), a + 1, high + 1)
                    if depth and word[depth] == last and word[depth - 1] == letter:
                        b = min(b, before + 1)
                if depth + 1 < n:
                    c = min(high + (word[depth + 1] != letter), b + 1)
                if min(a, b, c) <= 1:
                    stack.append((child, depth + 1, a, b, c, letter, mid))
        return False


@dataclass
class Model:
    words: frozenset[str]
    starts: frozenset[str]
    weight: np.ndarray
    trie: Trie = field(init=False, repr=False, default=None)
    kinds: dict[str, int] = field(init=False, repr=False, default_factory=dict)

    def __getstate__(self):
        return {"words": self.words, "starts": self.starts, "weight": self.weight}

    def __setstate__(self, state):
        self.__dict__.update(state, trie=None, kinds={})

    def _ready(self) -> None:
        long = [w for w in self.words if len(w) >= FUZZY_FROM]
        self.trie = Trie(long)
        # One edit leaves the first two or the last two letters as they are.
        self.heads = {w[:2] for w in long}
        self.tails = {w[-2:] for w in long}
        self.lengths = {n for w in long for n in (len(w) - 1, len(w), len(w) + 1)}

    def kind(self, word: str) -> int:
        """0: no hit, 1: a term, 2: within one edit of one, 3: a listed beginning."""
        if word in self.words:
            return 1
        if any(word[:n] in self.starts for n in STARTS):
            return 3
        if word.isascii() and not word.isalpha():
            plain = word.translate(LEET)
            if plain in self.words:
                return 2
        if (len(word) >= FUZZY_FROM and len(word) in self.lengths
                and (word[:2] in self.heads or word[-2:] in self.tails)
                and self.trie.within_one(word)):
            return 2
        return 0

    def features(self, text: str | None) -> np.ndarray:
        """One; terms, beginnings and quotations on a log scale; and hits by length."""
        out = np.zeros(5)
        out[0] = 1.0
        if not text:
            return out
        if self.trie is None:
            self._ready()
        low, kinds = text.lower(), self.kinds
        words = WORD.findall(low)
        if len(kinds) > KNOWN:
            kinds.clear()
        for word in set(words).difference(kinds):
            kinds[word] = self.kind(word)
        if not any(map(kinds.__getitem__, set(words))):
            return out
        terms = starts = quoted = 0.0
        found = list(WORD.finditer(low))
        marks = [m.start() for m in re.finditer(f"[{MARKS}\n]", low)]
        opened, at = False, 0
        for i, match in enumerate(found):
            while at < len(marks) and marks[at] < match.start():
                opened = low[marks[at]] != "\n" and not opened
                at += 1
            kind = kinds[match.group()]
            if not kind:
                continue
            value = 0.7 if kind == 2 else 1.0
            near = words[max(0, i - WINDOW):i]
            if opened or not SPEECH.isdisjoint(near):
                quoted += value
            elif kind == 3:
                starts += value
            else:
                terms += value
        out[1:] = (np.log1p(terms), np.log1p(starts), np.log1p(quoted),
                   min(1.0, 20 * (terms + starts) / len(words)))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        rows = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(rows @ self.weight, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps; the weights of hits stay at or above zero, the first is free."""
    weight = np.zeros(x.shape[1])
    weight[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (y - p) - penalty * weight
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        weight = weight + step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        weight[1:] = np.maximum(weight[1:], 0)
    return weight


def _evidence(sample: DataFrame) -> DataFrame:
    """Per word and beginning: toxic and other documents, near copies counted once."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, prints, labels = [], [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            if not words:
                continue
            # The least hashes of the words: near copies of a text agree on them mostly.
            print_ = min(xxhash.xxh3_64_intdigest(w) for w in words) >> 1
            listed = words | {"^" + w[:n] for w in words for n in STARTS if len(w) > n}
            terms += listed
            prints += [print_] * len(listed)
            labels += [toxic] * len(listed)
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(prints, pa.int64()), pa.array(labels, pa.int32())],
            ["term", "print", "toxic"])

    # A document has many terms: a few documents at a time.
    rows = by_batch(sample.select("text", "toxic"), work, "term string, print bigint, toxic int", 64)
    return rows.distinct().groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def learn(df: DataFrame, labels: DataFrame, key: str, text: str, label: str,
          sample: int = SAMPLE) -> Model:
    """The model of the documents that have a label 0 or 1; several labels of one key: the highest."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic")))
    known = written(known, "labels")
    number = known.count()
    few = known.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(max(1, number))) < sample)
    # About ``sample`` rows at most, whatever the number of labels.
    rows = written(df.select(F.col(key).alias("key"), F.col(text).alias("text"))
                   .join(F.broadcast(few), "key").select("key", "text", "toxic"), "labelled")
    counts = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = counts.bad, counts.n - counts.bad
    if not bad or not good:
        return Model(frozenset(), frozenset(), np.array([-np.log(3.0), 0, 0, 0, 0]))
    least = max(LEAST, SUPPORT * bad)
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    start = F.col("term").startswith("^")
    # Shares are of documents weighted as if both labels were as frequent.
    even = F.col("bad") / bad / (F.col("bad") / bad + F.col("good") / good)
    listed = (_evidence(rows).where(F.col("bad") >= least)
              .where(F.when(start, (share >= SURE_START) & (even >= 0.98)).otherwise((share >= SURE) & (even >= 0.95)))
              .orderBy(F.desc("bad"), "term").limit(TERMS).collect())
    words = frozenset(r.term for r in listed if not r.term.startswith("^"))
    starts = frozenset(r.term[1:] for r in listed if r.term.startswith("^"))
    model = Model(words, starts, np.zeros(5))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([model.features(t) for t in batch.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # As many rows of five numbers as the sample has.
    fit = by_batch(rows.select("text", "toxic"), work, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    fit = sorted((tuple(r.x), r.toxic, r["count"]) for r in fit)
    x = np.repeat(np.array([r[0] for r in fit]), [r[2] for r in fit], axis=0)
    y = np.repeat(np.array([r[1] for r in fit], float), [r[2] for r in fit])
    model.weight = logistic(x, y)
    return model


def scorer(model: Model) -> Column:
    """A function of a text column: the score from 0 to 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))
    return score
