"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised and cut where they exceed a sequence; what is packed then are only lengths. The configuration
linear program over the length histogram (at most ``capacity`` rows, whatever the input) is solved by multiplicative
weights, priced by a knapsack dynamic program, and rounded; every piece is placed by its rank among the pieces of its
length, which Spark computes from counts of hash ranges.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tenderlake.llm import shared
from tenderlake.llm.textbytes import IS_SPACED, LOWER, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Encoder:
    """Ids of texts by way of their distinct chunks between ASCII white space.

    The tokenizer drops white space, and neither its normaliser nor its splitter looks across it, so a text's ids are
    its chunks' ids one after the other. ASCII capitals are lower-cased first, as the normaliser would, save where a
    special token's text may stand. A chunk of letters and closing punctuation is the two of them; a new word of small
    letters goes to the tokenizer's model at once. The store is emptied when full.
    """

    CLOSED = re.compile(rb"(.*[^!-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

    def __init__(self, path: str, most: int = 1_000_000):
        tokenizer = _tokenizer(path)
        self.encode, self.model, self.most = tokenizer.encode_batch_fast, tokenizer.model, most
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, chunks: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.codes.update(zip(chunks, range(len(self.codes), len(self.codes) + len(chunks))))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and how many each has."""
        first, lengths = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(first - (ends - lengths), lengths) + np.arange(int(lengths.sum()))], lengths

    @staticmethod
    def word(chunk: bytes) -> str | None:
        """The chunk as one word of small letters in composed form, if it is one."""
        if (text := chunk.decode()).isascii():
            return text.lower() if text.isalpha() else None
        if not text.isalpha() or "\u03a3" in text or "\u0130" in text:  # letters whose small ones are not a letter's own
            return None
        return small if is_normalized("NFC", text) and is_normalized("NFC", small := text.lower()) and small.isalpha() else None

    def learn(self, chunks: list[bytes]) -> None:
        words, odd, closed = {}, [], []
        for chunk in chunks:
            if (word := self.word(chunk)) is not None:
                words[chunk] = word
            elif (m := self.CLOSED.fullmatch(chunk)) and (word := self.word(m[1])) is not None:
                closed.append((chunk, m[1], m[2]))
                if m[1] not in self.codes:
                    words[m[1]] = word
                if m[2] not in self.codes:
                    odd.append(m[2])
            else:
                odd.append(chunk)
        found = [[x.id for x in self.model.tokenize(w if w.isascii() else self.as_bytes(w)[0][0])] for w in words.values()]
        self.add(list(words), np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64))
        odd = list(dict.fromkeys(odd))
        found = [x.ids for x in self.encode([x.decode() for x in odd], add_special_tokens=False)]
        self.add(odd, np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64))
        if closed:
            parts = np.array([(self.codes[head], self.codes[tail]) for _, head, tail in closed])
            ids, lengths = self.take(parts.ravel())
            self.add([x[0] for x in closed], ids, lengths.reshape(-1, 2).sum(1))

    def batch(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.most:
            self.clear()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        marks = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        data = np.where(np.repeat(marks, np.diff(offsets)), data, LOWER[data]) if marks.any() else LOWER[data]
        solid, first = IS_SPACED[data], np.zeros(len(data) + 1, bool)
        first[1:-1] = ~solid[:-1]
        first[offsets] = True
        starts, packed = np.flatnonzero(first[:-1] & solid), np.concatenate([[0], np.cumsum(solid)])
        bounds = np.append(packed[starts], packed[-1])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid])]).dictionary_encode()
        chunks = found.dictionary.to_pylist()
        codes = np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(codes < 0).tolist()
        self.learn([chunks[i] for i in missing])
        codes[missing] = [self.codes[chunks[i]] for i in missing]
        ids, lengths = self.take(codes[found.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets[1:])]
        return np.split(ids, ends[:-1])


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a Python worker, so that each starts with the chunks of those before."""
    return _Encoder(path)


def tokenised_pieces(documents: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece (from 0), start, length and ids_crc32 (of the little-endian 32-bit ids).

    A document is its ids and then ``end_id``; null and empty texts are ``end_id`` alone. Only documents longer than
    ``capacity`` are cut, at its multiples. Rows with equal ids each give their pieces.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        gc.disable()  # nothing here makes cycles, and a collection walks the whole store
        try:
            for batch in pieces(batches, "text", 8 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(doc, k, at, len(x := ids[at : at + capacity]), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            gc.enable()

    return shared.only(documents, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, PIECES)


def _knapsack(lengths: np.ndarray, profit: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best profit for every capacity, copies unlimited, and the item added last (-1: none, take one unit less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = profit[: fit[c]] + best[c - lengths[: fit[c]]]
        j = int(gain.argmax())
        best[c], last[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
    return best, last


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 150, slack: float = 0.05, step: float = 0.3) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Fractional cover of ``counts`` by configurations: ((item, copies), ...) and how often, most often first.

    Multiplicative weights: an item's price falls exponentially as it is covered. Each round prices all configurations by
    one knapsack program and raises, for every item, the best one holding it, if that is within ``slack`` of the best
    of all. At the end all amounts are scaled so that no item is uncovered.
    """
    covered, amount = np.zeros(len(lengths)), defaultdict(float)
    for _ in range(rounds):
        price = np.exp(covered.min() - covered) / counts
        best, last = _knapsack(lengths, price, capacity)
        value = price + best[capacity - lengths]
        seeds, added, raised = np.flatnonzero(value >= (1 - slack) * value.max()), np.zeros(len(lengths)), []
        for seed in seeds:
            held, c = defaultdict(int, {int(seed): 1}), capacity - int(lengths[seed])
            while c > 0:
                if (j := int(last[c])) < 0:
                    c -= 1
                else:
                    held[j] += 1
                    c -= int(lengths[j])
            key = tuple(sorted(held.items()))
            times = min(counts[i] / k for i, k in key)
            raised.append((key, times))
            for i, k in key:
                added[i] += times * k / counts[i]
        scale = step / added.max()
        covered += added * scale
        for key, times in raised:
            amount[key] += times * scale
    if covered.min() > 0:
        amount = {k: v / covered.min() for k, v in amount.items()}
    return sorted(amount.items(), key=lambda x: (-x[1], x[0]))


def pack_histogram(histogram: dict[int, int], capacity: int = 2048, rounds: int = 150, passes: int = 2) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Sequences that hold every piece once: (number of sequences, ((length, copies), ...)), by the rounded program.

    A configuration is used as often as its amount, rounded down, and the pieces left allow. The program is solved
    anew for what is left, and what then remains goes by best fit, longest first, into the gaps and into new sequences.
    The work depends on the number of lengths, not of pieces.
    """
    left, groups = {n: k for n, k in sorted(histogram.items()) if k > 0}, []
    for _ in range(passes):
        items = [n for n in left if left[n] and n < capacity]
        if not items or sum(left[n] for n in items) < 2 * len(items):
            break
        lengths = np.array(items)
        for held, times in configurations(lengths, np.array([left[n] for n in items], float), capacity, rounds):
            number = min([int(times), *(left[items[i]] // k for i, k in held)])
            if number:
                groups.append((number, tuple((items[i], k) for i, k in held)))
                for i, k in held:
                    left[items[i]] -= number * k
    return _best_fit(groups, left, capacity)


def _best_fit(groups: list, left: dict[int, int], capacity: int) -> list:
    """Best fit over groups of equal sequences; gaps: by room, the groups with that much of it."""
    gaps, rooms = defaultdict(list), 0  # rooms: bit r is set if some group has room r

    def put(number: int, held: tuple) -> None:
        nonlocal rooms
        room = capacity - sum(n * k for n, k in held)
        gaps[room].append((number, held))
        rooms |= 1 << room

    for group in groups:
        put(*group)
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                number, held = gaps[room].pop()
                if not gaps[room]:
                    rooms &= ~(1 << room)
            else:
                room, number, held = capacity, todo, ()
            each = room // length
            full = min(number, todo // each)
            if full:
                put(full, (*held, (length, each)))
                todo -= full * each
                if held and number > full:
                    put(number - full, held)
            else:
                put(1, (*held, (length, todo)))
                if held and number > 1:
                    put(number - 1, held)
                todo = 0
    return [x for r in sorted(gaps) for x in gaps[r]]


def _slots(groups: list) -> dict[str, np.ndarray]:
    """For every length, in order, stretches of ranks that one group takes: sorted by (length, rank)."""
    rows, taken, sequence = [], defaultdict(int), 0
    for number, held in groups:
        offset = 0
        for length, each in sorted(held, reverse=True):
            rows.append((length, taken[length], sequence, each, offset))
            taken[length] += number * each
            offset += length * each
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = 150, range_rows: int = 8192) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with (doc_id, piece, length): sequences of at most ``capacity``, gapless from 0.

    Needs ``pieces`` to be a stored table, as it is read twice. Rows of one length and hash range meet in a task. The
    plan that goes to all tasks has a few rows for each of at most ``capacity`` lengths.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = _slots(pack_histogram(histogram, capacity, rounds))
    ranges = max(1, -(-sum(histogram.values()) // range_rows))
    dealt = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges)))
    ahead = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "range").count().select("length", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    ranked = dealt.join(counts, ["length", "range"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(slots["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row, end = first[length].copy(), first[length + 1] - 1
            while (lower := row < end).any():  # the last stretch of its length that starts at or before the rank
                middle = (row + end + 1) // 2
                right = slots["rank"][middle] <= rank
                row, end = np.where(lower & right, middle, row), np.where(lower & ~right, middle - 1, end)
            within = rank - slots["rank"][row]
            sequence, at = slots["sequence"][row] + within // slots["each"][row], slots["offset"][row] + within % slots["each"][row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(at)], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """Tokenises, cuts and packs documents (doc_id, text); see ``tokenised_pieces`` and ``pack``. An empty table packs to no row."""
    return pack(shared.written(tokenised_pieces(documents, tokenizer=tokenizer, capacity=capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.documents(spark, sf_dir))
