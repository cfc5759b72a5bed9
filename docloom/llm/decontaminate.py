"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts the words of its documents into shards and builds a suffix array of each shard by prefix
doubling. Every suffix of every benchmark item is binary-searched in it, word by word, which yields its
longest verbatim match and the interval of suffixes that begin with the suffix's window. Documents are
never shuffled: a shard holds whole documents, or overlapping segments of one that is longer than a shard.
The benchmark is sent out in blocks of bounded size, and a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import chunks, sha256_hex

WINDOW = 10
SHARD_WORDS = 250_000
#: Characters of text that are made words at once; about a shard.
CHUNK_CHARS = 1_500_000
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 16_000_000
#: In bytes of UTF-8: A-Z become a-z, other ASCII that is no letter or digit becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Block:
    """Benchmark items as one array of word numbers: item j has words[starts[j]:starts[j + 1]]."""

    ids: list[str | None]
    vocabulary: list[bytes]
    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> Block:
        """Items without words have no windows; rows of one id, null too, are told apart only by text."""
        seen: dict[bytes, int] = {}
        ids, words, starts = [], [], [0]
        for item_id, text in items:
            if own := words_of(text):
                ids.append(None if item_id is None else str(item_id))
                words += [seen.setdefault(w, len(seen)) for w in own]
                starts.append(len(words))
        return cls(ids, list(seen), np.array(words, np.int64), np.array(starts, np.int64))

    @property
    def longest(self) -> int:
        return int(np.diff(self.starts).max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, by their first `depth` numbers at least (prefix doubling, ties only)."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    value = ids[sa]
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while k < depth:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        sub = sa[slots]
        after = sub + k
        key = rank[sub] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[slots] = sub
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        rank[sub] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        k *= 2
    return sa


def _bound(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, value: np.ndarray) -> np.ndarray:
    """Binary search: first place in [lo, hi) whose suffix has a number >= value at offset d."""
    lo, hi, last = lo.copy(), hi.copy(), len(ids) - 1
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        at = sa[mid] + d
        less = np.where(at > last, -1, ids[np.minimum(at, last)]) < value[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(ids: np.ndarray, sa: np.ndarray, block: Block, ranks: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(longest, position, lo, hi, width) for each benchmark suffix.

    longest: words of its longest verbatim match, found at that position. [lo, hi): the places in sa of the suffixes
    that begin with its window of `width` words; empty where the window doesn't occur or the suffix has none.
    Beyond the window, a suffix that occurs only where the one before it in its item does is not searched any further:
    its longest match is that one's without its first word. So a long verbatim match costs its length once.
    """
    n, starts = len(block.words), block.starts
    target = ranks[block.words] if n else block.words
    item = np.repeat(np.arange(len(block.ids)), np.diff(starts))
    left, length = starts[item + 1] - np.arange(n), np.diff(starts)[item]
    width = np.where(left >= window, window, np.where(left == length, left, 0))
    lo, hi = np.zeros(n, np.int64), np.full(n, len(ids))
    longest, place, wlo, whi, before = (np.zeros(n, np.int64) for _ in range(5))
    alone = np.ones(n + 1, bool)  # suffixes whose longest match is their own
    active, d = np.arange(n), 0
    while len(active):
        active = active[(left[active] > d) & (target[np.minimum(active + d, n - 1)] >= 0)]
        value = target[active + d]
        a = _bound(ids, sa, lo[active], hi[active], d, value)
        b = _bound(ids, sa, a, hi[active], d, value + 1)
        keep = a < b
        active, a, b = active[keep], a[keep], b[keep]
        if d >= window and len(active):
            before[active] = hi[active] - lo[active]
            here = np.zeros(n + 1, np.int64)
            here[active + 1] = b - a  # of the suffix before, one word longer
            first = np.zeros(n + 1, bool)
            first[starts] = True
            led = (here[active] == before[active]) & ~first[active]
            alone[active[led]] = False
        lo[active], hi[active] = a, b
        d += 1
        longest[active], place[active] = d, a
        full = active[width[active] == d]
        wlo[full], whi[full] = lo[full], hi[full]
        active = active[alone[active]]
    leader = np.maximum.accumulate(np.where(alone[:n], np.arange(n), 0)) if n else np.arange(0)
    position = sa[place] if len(sa) else place
    return longest[leader] - (np.arange(n) - leader), position[leader] + np.arange(n) - leader, wlo, whi, width


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the number of the range each comes from."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


class Shard:
    """Segments of documents: words [begin, end) of document `doc`, of which [own, own_end) are counted here."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.segments: list[tuple[int, int, int, int]] = []  # doc, at, own_at, own_end

    def add(self, doc: int, words: list[bytes], begin: int, end: int, own: int, own_end: int) -> None:
        seen, at = self.seen, len(self.ids)
        self.ids += [seen.setdefault(w, len(seen) + 1) for w in (words if end - begin == len(words) else words[begin:end])]
        self.ids.append(0)  # parts documents: no word has this number
        self.segments.append((doc, at, at + own - begin, at + own_end - begin))

    def hits(self, blocks: list, window: int, longest: bool = False) -> Iterator[tuple[Block, np.ndarray, list, list]]:
        """For each block: (block, counts of hit words by segment, (segment, item) pairs, longest matches)."""
        ids = np.array(self.ids, np.int64)
        at = np.array([s[1] for s in self.segments])
        own = np.array([s[2:] for s in self.segments])
        sa, covered = None, np.zeros(len(ids) + 1, np.int64)
        for get in blocks:
            block = get()
            if sa is None or block.longest > depth:
                depth = max(block.longest, window)
                sa = suffix_array(ids, depth)
            ranks = np.array([self.seen.get(w, -1) for w in block.vocabulary], np.int64)
            length, position_of, lo, hi, width = search(ids, sa, block, ranks, window)
            found = np.flatnonzero(lo < hi)
            item = np.searchsorted(block.starts, found, "right") - 1
            # one interval for all suffixes with the same window
            interval, first, which = np.unique(lo[found] * 16 * window + width[found], return_index=True, return_inverse=True)
            where, owner = _ranges(lo[found][first], hi[found][first])
            position = sa[where]
            covered += np.bincount(position, minlength=len(covered)) - np.bincount(position + width[found][first][owner], minlength=len(covered))
            segment = np.searchsorted(at, position, "right") - 1
            # an occurrence counts where it touches the words that its segment owns
            touches = (position < own[segment, 1]) & (position + width[found][first][owner] > own[segment, 0])
            pairs = np.unique(owner[touches] * len(at) + segment[touches])
            order = np.argsort(which, kind="stable")
            begins = np.searchsorted(which[order], np.arange(len(interval) + 1))
            items, of = _ranges(begins[pairs // len(at)], begins[pairs // len(at) + 1])
            hit_items = np.unique((pairs % len(at))[of] * max(1, len(block.ids)) + item[order][items]) if len(pairs) else pairs
            matches = []
            if longest:
                for q in np.flatnonzero(length):
                    s = int(np.searchsorted(at, p := position_of[q], "right") - 1)
                    j = int(np.searchsorted(block.starts, q, "right") - 1)
                    matches.append((s, int(p - at[s]), j, int(q - block.starts[j]), int(length[q])))
            yield block, None, [(int(x) // len(block.ids), int(x) % len(block.ids)) for x in hit_items], matches
        total = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
        yield None, total[own[:, 1]] - total[own[:, 0]], [], []


def _scan(texts: list[str | None], blocks: list, window: int, shard_words: int, overlap: int) -> Iterator[tuple[int, int, int, list[str], int]]:
    """(index of the text, its words, its hit words, ids of its items, number of its items) in the order of the texts."""
    n_words, n_hit, items = [0] * len(texts), [0] * len(texts), [set() for _ in texts]

    def flush(shard: Shard) -> None:
        for block, counts, pairs, _ in shard.hits(blocks, window):
            if block is None:
                for (doc, *_), n in zip(shard.segments, counts.tolist(), strict=True):
                    n_hit[doc] += n
            else:
                for s, j in pairs:
                    items[shard.segments[s][0]].add(block.ids[j])

    shard = Shard()
    for i, text in enumerate(texts):
        words = words_of(text)
        n_words[i] = len(words)
        for own in range(0, len(words), shard_words):
            own_end = min(own + shard_words, len(words))
            begin, end = max(0, own - overlap), min(len(words), own_end + overlap)
            if shard.ids and len(shard.ids) + end - begin > shard_words:
                flush(shard)
                shard = Shard()
            shard.add(i, words, begin, end, own, own_end)
    if shard.ids:
        flush(shard)
    yield from zip(range(len(texts)), n_words, n_hit, (sorted(x - {None}) for x in items), map(len, items), strict=True)


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[list, int]:
    """Broadcast blocks of about block_chars characters each, and the most words of an item."""
    spark = benchmark.sparkSession
    benchmark = benchmark.select("item_id", "text")
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    blocks, longest = [], 0
    for b in range(n):
        # one block at a time is on the driver
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        block = Block.of([(r[0], r[1]) for r in rows])
        longest = max(longest, block.longest)
        blocks.append(spark.sparkContext.broadcast(block))
    return blocks, longest


def _getters(blocks: list) -> list:
    """Functions that give a block; with several, the one before is let go first."""
    def one(broadcast):
        def get() -> Block:
            if len(blocks) > 1:
                for other in blocks:
                    if other is not broadcast and hasattr(other, "_value"):
                        del other._value
            return broadcast.value
        return get
    return [one(b) for b in blocks]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null and empty texts
    have no words; items without words have no windows; an item id that is repeated counts once. Items with a
    null id count as one item, which items_sha256 leaves out. Texts of any length are searched whole, in shards; windows
    that tie (several items, several places) all count. An empty benchmark contaminates nothing; repeated documents give
    a row each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    blocks, longest = _blocks(benchmark, block_chars)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        getters = _getters(blocks)
        for ids, texts in chunks(batches, CHUNK_CHARS):
            rows = list(_scan(texts, getters, window, shard_words, max(longest, window)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([sha256_hex(",".join(r[3])) for r in rows]), pa.array([r[2] > 0 for r in rows])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    id_field = docs.schema["doc_id"]
    id_type = pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.int32() if isinstance(id_field.dataType, T.IntegerType) else pa.string()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_field.dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each shard and benchmark suffix, one longest verbatim match: doc_id, doc_word, item_id, item_word, n_words.

    Word offsets count from 0; matches under min_words are left out.
    """
    blocks, longest = _blocks(benchmark, block_chars)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        getters = _getters(blocks)
        for ids, texts in chunks(batches):
            shard, out = Shard(), []
            shards = []
            for i, text in enumerate(texts):
                words = words_of(text)
                for own in range(0, len(words), shard_words):
                    end = min(len(words), own + shard_words + longest)
                    if shard.ids and len(shard.ids) + end - own > shard_words:
                        shards.append(shard)
                        shard = Shard()
                    shard.add(i, words, own, end, own, end)
                    shard.segments[-1] += (own,)
            for part in [*shards, shard]:
                if part.ids:
                    begins = [s[4] for s in part.segments]
                    part.segments = [s[:4] for s in part.segments]
                    for block, _, _, found in part.hits(getters, min_words, longest=True):
                        out += [(ids[part.segments[s][0]], begins[s] + p, block.ids[j], q, n) for s, p, j, q, n in found if n >= min_words]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "doc_word", "item_id", "item_word", "n_words"), r, strict=True)) for r in out], schema=pa.schema([("doc_id", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, doc_word long, item_id string, item_word long, n_words long")


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns.

    Null and empty texts stay; texts of any length are searched whole; repeated rows all stay or all go; columns keep
    their names and values; an empty table gives no rows, an empty benchmark all.
    """
    blocks, longest = _blocks(benchmark, options.get("block_chars", BLOCK_CHARS))
    window, shard_words = options.get("window", WINDOW), options.get("shard_words", SHARD_WORDS)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        getters = _getters(blocks)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep: list[bool] = []
            for (part,) in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], CHUNK_CHARS, ("text",)):
                keep += [r[2] == 0 for r in _scan(part, getters, window, shard_words, max(longest, window))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
