"""Byte-level BPE: encode and decode whole texts by a public rank file.

Every match of the split pattern is merged on its own. A segment tree over the byte positions of
the match holds the rank of each live pair; its root names the leftmost pair of least rank, and a
merge only updates the leaves of the merged pair and of its two live neighbours. A match of n
bytes takes O(n log n), also where one match is a whole text.

Nulls count as empty texts; empty texts have no ids and decode to no bytes. Repeated rows give
repeated rows. Only the named columns are read, so further columns, whatever their names, neither
clash nor pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, pieces_of

NO_PAIR = 1 << 60
#: Remembered texts of each kind and generation in a Python worker.
REMEMBERED = 160_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, one base64 token and one number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: the leftmost pair of least rank is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    tokens = [piece[i:i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    leaves = 1 << max(1, (n - 2).bit_length())
    tree = [NO_PAIR] * leaves
    tree += [get(piece[i:i + 2], NO_PAIR) for i in range(n - 1)]
    tree += [NO_PAIR] * (2 * leaves - len(tree))
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    while (least := tree[1]) < NO_PAIR:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] != least:
                node += 1
        i = node - leaves
        gone = after[i]
        merged = tokens[i] = tokens[i] + tokens[gone]
        tokens[gone] = b""
        after[i] = follower = after[gone]
        changed = []
        if gone < n - 1:
            changed.append((gone, NO_PAIR))
        if follower < n:
            before[follower] = i
            changed.append((i, get(merged + tokens[follower], NO_PAIR)))
        else:
            changed.append((i, NO_PAIR))
        previous = before[i]
        if previous >= 0:
            changed.append((previous, get(tokens[previous] + merged, NO_PAIR)))
        for position, rank in changed:
            node = leaves + position
            if tree[node] == rank:
                continue
            tree[node] = rank
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                if right < left:
                    left = right
                if tree[node] == left:
                    break
                tree[node] = left
                node >>= 1
    return [ranks[token] for token in tokens if token]


class Merger:
    """The same merges for many short matches at once: one row of a tree matrix per match.

    Ids are ranks, so a merged pair is known by its rank. ``pairs`` holds every pair of ids whose
    bytes together are a token, as sorted codes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        codes, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        self.pairs = np.array(codes, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = (self.pairs[at] == code) & (left >= 0) & (right >= 0)
        return np.where(known, self.merged[at], NO_PAIR)

    def _rows(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Matches of 2 to ``leaves`` bytes; column ``leaves`` stands for the end of the match."""
        count = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8)
        column = np.arange(leaves)
        ids = np.full((count, leaves + 1), -1, np.int64)
        ids[:, :leaves] = np.where(column < length[:, None],
                                   self.bytes[raw.reshape(count, leaves)], -1)
        after = np.broadcast_to(np.arange(1, leaves + 2), (count, leaves + 1)).copy()
        after[after >= length[:, None]] = leaves
        before = np.broadcast_to(np.arange(-1, leaves), (count, leaves + 1)).copy()
        tree = np.full((count, 2 * leaves), NO_PAIR, np.int64)
        tree[:, leaves:] = self._rank(ids[:, :leaves], ids[:, 1:])
        level = leaves // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2],
                                                  tree[:, 2 * level + 1:4 * level:2])
            level //= 2

        def put(row: np.ndarray, position: np.ndarray, rank: np.ndarray | int) -> None:
            node = position + leaves
            tree[row, node] = rank
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(row):
            least, node = tree[row, 1], np.ones(len(row), np.int64)
            for _ in range(leaves.bit_length() - 1):
                node = 2 * node
                node += tree[row, node] != least
            i = node - leaves
            gone = after[row, i]
            follower = after[row, gone]
            ids[row, i], ids[row, gone] = least, -1
            after[row, i] = follower
            before[row, follower] = i
            put(row, gone, NO_PAIR)
            put(row, i, self._rank(least, ids[row, follower]))
            previous = before[row, i]
            some = previous >= 0
            put(row[some], previous[some], self._rank(ids[row[some], previous[some]], least[some]))
            row = row[tree[row, 1] < NO_PAIR]
        live = ids >= 0
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct match as little-endian bytes."""
        out, by_size = {}, {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) > 64:
                out[piece] = np.array(merge(piece, self.ranks), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for leaves, group in by_size.items():
            for start in range(0, len(group), 4096):
                part = group[start:start + 4096]
                out.update(zip(part, self._rows(part, leaves)))
        return out


class Memory:
    """Remembered results in two generations: when the young one is full, the old one goes.

    What is asked for moves to the young generation, so frequent keys stay. ``work`` gets a list
    of distinct keys. Full means so many entries, or as many characters as 16 an entry.
    """

    def __init__(self, work: Callable[[list], dict], entries: int = REMEMBERED):
        self.work, self.entries = work, entries
        self.young, self.old, self.size = {}, {}, 0

    def learn(self, keys: set) -> Callable:
        """A look-up that knows all the keys; new ones are worked out together."""
        new = keys.difference(self.young)
        if new:
            if len(self.young) + len(new) > self.entries or self.size > 16 * self.entries:
                self.old, self.young, self.size, new = self.young, {}, 0, keys
            old = self.old
            known = {key: old[key] for key in new if key in old}
            self.young.update(known)
            new = new.difference(known)
            self.young.update(self.work(list(new)))
            self.size += sum(map(len, new)) + sum(map(len, known))
        return self.young.__getitem__


def coder(ranks: dict[bytes, int], pattern: str) -> Memory:
    """Ids of text chunks as little-endian bytes: split by the pattern, each match merged.

    A chunk that begins with a visible character stands for itself after a space.
    """
    find, merger = regex.compile(pattern).findall, Merger(ranks)

    def of_matches(texts: list[str]) -> dict[str, bytes]:
        coded = [text.encode("utf-8") for text in texts]
        return dict(zip(texts, map(merger.ids(coded).__getitem__, coded)))

    matches = Memory(of_matches)

    def of_chunks(chunks: list[str]) -> dict[str, bytes]:
        split = [find(c if c[0].isspace() else " " + c) for c in chunks]
        look = matches.learn({match for found in split for match in found})
        return {c: b"".join(map(look, found)) for c, found in zip(chunks, split)}

    return Memory(of_chunks)


def cut_text(text: str) -> list[str]:
    """The text after a line break, in chunks whose ids make up those of the whole.

    No match of the pattern reaches over the left side of a single space or line break that
    stands between two visible characters, so the text splits there. Other white space stays
    inside a chunk. The space that begins a chunk is left out.
    """
    text = "\n" + text
    parts, visible = text.replace("\n", " \n").split(" ")[1:], text.split()
    if (len(parts) == len(visible) and "" not in parts
            and len("".join(visible)) == len(text) - text.count(" ") - text.count("\n")):
        return parts
    found = [m.start() for m in CUTS.finditer(text)]
    chunks = [text[a:b] for a, b in zip([0, *found], [*found, len(text)])]
    return [c[1:] if c[0] == " " and not c[1].isspace() else c for c in chunks]


CUTS = regex.compile(r"(?<=\S)(?=[ \n]\S)")


def encode_texts(texts: list[str | None], chunks: Memory) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    cut = [cut_text(text) if text and not text[0].isspace() else None for text in texts]
    look = chunks.learn({chunk for text in cut if text for chunk in text})
    # The line break in front is a match, and an id, of its own.
    out = [b"".join(map(look, text))[4:] if text else b"" for text in cut]
    for i, text in enumerate(texts):
        if text and cut[i] is None:
            out[i] = _spaced_first(text, chunks)
    return out


def _spaced_first(text: str, chunks: Memory) -> bytes:
    """Ids of a text that begins with white space: that run and what follows it is one chunk."""
    visible = len(text) - len(text.lstrip())
    first = next((m.start() for m in CUTS.finditer(text, visible)), len(text))
    head = text[:first]
    rest = cut_text(text[first + 1:]) if first < len(text) and text[first] == "\n" else None
    if rest is None:
        head, rest = text, []
    return b"".join(map(chunks.learn({head, *rest}), [head, *rest]))


@lru_cache(maxsize=2)
def _chunks(path: str, pattern: str) -> Memory:
    return coder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def decode_ids(ids: bytes, vocabulary: dict[int, bytes]) -> bytes:
    """The bytes that little-endian ids stand for; an id outside the vocabulary is an error."""
    return b"".join(map(vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """One row per input row: key, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks, ids = _chunks(ranks_path, pattern), []
        for piece in pieces_of(batch):
            ids += encode_texts(piece.column(1).to_pylist(), chunks)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()),
             pa.array([len(i) // 4 for i in ids], pa.int64())], ["key", "ids", "n_tokens"])

    rows = by_batch(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work,
                    f"key {kind}, ids binary, n_tokens bigint")
    return rows.withColumnRenamed("key", key)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids as ``out``, next to the other columns."""
    if out in df.columns:
        raise ValueError(f"a column {out} is there already")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _vocabulary(ranks_path)
        back = [decode_ids(i or b"", vocabulary)
                for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return by_batch(df, work, f"{fields}, {out} binary")
