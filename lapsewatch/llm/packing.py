"""Packing documents into sequences: large-item matching, then best fit.

Texts become token ids followed by a separator id; only documents longer than a sequence are cut.
How to pack depends on the lengths alone, so the plan is made on the count of each length, which
are at most as many numbers as a sequence has tokens, whatever the number of documents: pieces
above a third of the capacity go at most two to a sequence and are matched greedily, the longest
with the longest that fits; smaller ones, longest first, go where they leave the least room. The
plan says for every length which ranks go where; ranks are counted in salted groups, so a length
that a third of all rows share is spread over all tasks.

Nulls and empty texts are one separator id. Repeated rows are packed each on its own. Only the
named columns are read, so further columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch.llm.bpe import Memory
from lapsewatch.llm.common import by_batch, partitions, pieces_of, written

CAPACITY = 2048
SEPARATOR = 0
#: Remembered words, and chunks of text, of each generation in a Python worker.
CHUNKS = 80_000
WORDS = 160_000
#: Texts that are split and numbered at once.
TOGETHER = 512
#: Rows of one length in one ranking group, about.
RANKED_TOGETHER = 100_000


#: ASCII marks that may follow a word; the tokenizer splits between a letter and any of them.
MARKS = ".,;:!?%$&#*)"
#: The first character for which lower case and composition are left to the tokenizer.
PLAIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones of Latin-1
    for themselves, the other bytes, in order, for the characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _memories(path: str) -> tuple[Memory, Memory]:
    """For words, and for whole chunks: ids of the text between two spaces or line breaks; no token reaches over those.

    A chunk is a word and the marks after it. Lower-case words of plain letters are one unit of
    the tokenizer and go straight to its merges, all else takes its whole way, as it stands where
    it holds the name of a special token in any case.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    merges, letters = tokenizer.model.tokenize, _byte_letters()
    special = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]

    def of_words(words: list[str]) -> dict[str, bytes]:
        out, other = {}, []
        for word in words:
            if word.isalpha() and word.islower() and max(word) < PLAIN_END:
                coded = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                out[word] = array("I", [token.id for token in merges(coded)]).tobytes()
            else:
                other.append(word)
        found = tokenizer.encode_batch_fast(other, add_special_tokens=False)
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, found))
        return out

    words = Memory(of_words, WORDS)

    def of_chunks(chunks: list[str]) -> dict[str, bytes]:
        split = []
        for chunk in chunks:
            word = chunk.rstrip(MARKS)
            low = word.lower()
            if low and low[-1].isalpha() and max(word) < PLAIN_END and not any(s in low for s in special):
                split.append((low, chunk[len(word):]))
            else:
                split.append((chunk, ""))
        look = words.learn({part for pair in split for part in pair})
        return {c: look(word) + look(marks) for c, (word, marks) in zip(chunks, split)}

    return words, Memory(of_chunks, CHUNKS)


def _coded(values: pa.Array, memory: Memory) -> pa.Array:
    """The ids of every value as bytes, each distinct one looked up once."""
    coded = values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    look = memory.learn(set(distinct))
    return pa.array([look(c) for c in distinct], pa.large_binary()).take(coded.indices)


def _of_distinct(chunks: pa.Array, path: str) -> pa.Array:
    """Ids of distinct chunks. Those of an ASCII word and marks are parted by Arrow, others in Python."""
    words, whole = _memories(path)
    # The names of the special tokens begin with "<|"; chunks with that are left to the tokenizer.
    parted = pc.extract_regex(chunks, rf"(?s)^(?P<word>.*[A-Za-z])(?P<marks>[{re.escape(MARKS)}]*)$")
    plain = pc.and_(pc.and_(pc.string_is_ascii(chunks), parted.is_valid()),
                    pc.invert(pc.match_substring(chunks, "<|")))
    at, other = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, pc.invert(plain)))
    parted = parted.take(pa.array(at))
    ids = pc.binary_join_element_wise(
        _coded(pc.ascii_lower(parted.field("word")), words), _coded(parted.field("marks"), words),
        pa.scalar(b"", pa.large_binary()))
    place = np.argsort(np.r_[at, other], kind="stable")
    return pa.concat_arrays([ids, _coded(chunks.take(pa.array(other)), whole)]).take(pa.array(place))


def token_ids(texts: pa.Array, path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers, without a separator.

    Arrow splits the texts and numbers their distinct chunks; only those are tokenised, and one
    gather lays out the ids of all texts, so no Python runs per token.
    """
    chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(pc.cast(texts, pa.large_string()), ""), "\n", " "), " ")
    coded = chunks.flatten().dictionary_encode()
    flat = _of_distinct(coded.dictionary, path).take(coded.indices)
    if not len(flat):
        return [b""] * len(texts)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = memoryview(flat.buffers()[2] or b"")
    at = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
    return [bytes(data[i:j]) for i, j in zip(at, at[1:])]


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY,
           separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 and, if asked for, the ids."""
    kind = df.schema[key].dataType.simpleString()
    end, width = int(separator).to_bytes(4, "little"), 4 * capacity

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, ids = [], [], []
        for at, part in enumerate(pieces_of(batch, TOGETHER)):
            for i, coded in enumerate(token_ids(part.column(1), path)):
                coded += end
                for number, start in enumerate(range(0, len(coded), width)):
                    rows.append(at * TOGETHER + i)
                    numbers.append(number)
                    ids.append(coded[start:start + width])
        number = np.array(numbers, np.int32)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number),
                   pa.array(number.astype(np.int64) * capacity),
                   pa.array([len(i) // 4 for i in ids], pa.int64()),
                   pa.array([zlib.crc32(i) for i in ids], pa.int64())]
        names = ["key", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = by_batch(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work,
                    schema + (", ids binary" if with_ids else ""))
    return rows.withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, ...]]]:
    """For each length the runs of ranks: (first rank, pieces a sequence, sequence, offset).

    Sequences of one kind have consecutive numbers, so a run says where all its ranks go:
    sequence + (rank - first) // pieces, at offset + length * ((rank - first) % pieces).
    """
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, ...]]] = {length: [] for length in counts}
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    sequences = 0

    def place(length: int, number: int, each: int, first: int, offset: int) -> None:
        runs[length].append((taken[length], each, first, offset))
        taken[length] += number
        left[length] -= number

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    for i, length in enumerate(large):
        for mate in (m for m in large[i:] if m + length <= capacity):
            pairs = left[length] // 2 if mate == length else min(left[length], left[mate])
            if pairs:
                if mate == length:
                    place(length, 2 * pairs, 2, sequences, 0)
                else:
                    place(length, pairs, 1, sequences, 0)
                    place(mate, pairs, 1, sequences, length)
                gaps.setdefault(capacity - length - mate, []).append((sequences, pairs))
                sequences += pairs
            if not left[length]:
                break
        if left[length]:
            gaps.setdefault(capacity - length, []).append((sequences, left[length]))
            sequences += left[length]
            place(length, left[length], 1, sequences - left[length], 0)
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        for room in sorted(gap for gap in gaps if gap >= length):
            while left[length] and gaps.get(room):
                first, number = gaps[room].pop()
                each = min(room // length, left[length])
                filled = min(number, left[length] // each)
                place(length, filled * each, each, first, capacity - room)
                gaps.setdefault(room - each * length, []).append((first, filled))
                if number > filled:
                    gaps[room].append((first + filled, number - filled))
            if not gaps.get(room):
                gaps.pop(room, None)
            if not left[length]:
                break
        while left[length]:
            each = min(capacity // length, left[length])
            filled = left[length] // each
            place(length, filled * each, each, sequences, 0)
            gaps.setdefault(capacity - each * length, []).append((sequences, filled))
            sequences += filled
    return runs


def pack(rows: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to written rows that have ``key``, piece, length and ids_crc32."""
    spark = rows.sparkSession
    sizes = {r.length: r.n for r in
             rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(sizes, capacity)
    salts = max(partitions(spark), sum(sizes.values()) // RANKED_TOGETHER + 1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("length").orderBy("salt")) - F.col("n"))
              .drop("n"))
    order = Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")
    ranked = (salted.withColumn("place", F.row_number().over(order))
              .join(before, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("place") - 1)
              .drop("salt", "place", "before"))
    tables = {length: np.array(found, np.int64) for length, found in runs.items()}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for value, at in zip(values.tolist(), np.split(order, starts[1:])):
            run = tables[value]
            row = run[np.searchsorted(run[:, 0], rank[at], "right") - 1]
            past = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + past // row[:, 1]
            offset[at] = row[:, 3] + value * (past % row[:, 1])
        keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
            [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in ranked.drop("rank").schema.fields)
    return by_batch(ranked, work, f"{fields}, sequence_id bigint, offset bigint")


def pack_texts(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY,
               with_ids: bool = False) -> DataFrame:
    """Texts to packed pieces: tokenised once into a written table, then placed."""
    rows = written(pieces(df, key, text, path, capacity, with_ids=with_ids), "pieces")
    return pack(rows, key, capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order, at most ``capacity`` of them."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (ids, p) -> concat(ids, p.ids))").alias("ids"))
