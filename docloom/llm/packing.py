"""Hierarchical multi-length packing of tokenised documents.

Documents become token ids and are cut into windows of the longest tier; what is left of a document is a piece.
Pieces are dealt at random into groups of about GROUP_TOKENS tokens, and a task packs one group:
1. A piece is routed to the smallest context-size tier that holds it.
2. Tiers are packed from the longest to the shortest. The longest piece of a tier opens a window of the tier's size;
   its gap is filled by the longest shorter pieces that fit, which come from shorter tiers.
3. Where none fits, the shortest longer piece is cut: its head fills the gap, the rest is routed anew. So every
   window of a group is full but the last one.
4. Windows are dealt to step groups, each to the one with the fewest tokens so far, longest first.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import chunks, write_shared

TIERS = (2048, 1024, 512, 256)
#: Tokens of a group, which bound a task's memory, and of a step group.
GROUP_TOKENS, STEP_TOKENS = 1 << 20, 1 << 16
TOKENIZER = "word_bpe_49k.json"
END = 1
#: Characters of texts that are encoded at once; a longer text is alone.
CHUNK_CHARS = 2_000_000
#: Words, and parts of words, whose ids a worker remembers at most, but for those of one chunk; then it begins anew.
REMEMBERED = 1_000_000
#: Stands between words that are encoded at once; a single id, of a byte that plain words don't have.
BETWEEN = "\x01"
#: Numbers of sequences in a group.
SEQUENCE_BITS = 24
#: Words of these classes alone fall apart into letters, digits and signs wherever they stand.
_plain = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~\n\r\t]+")
_parts = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class WordIds:
    """Token ids of texts by a tokenizer whose words don't cross blanks; each different word is encoded once.

    encode() gives what the tokenizer gives for whole texts. Words of plain letters, digits and signs are encoded by their
    parts, which the tokenizer separates anyway; all others go to it as they are. Words and parts are remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        made |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare = Tokenizer.from_str(json.dumps(made))
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        (self.between,) = self.bare.encode([BETWEEN], is_pretokenized=True, add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        known, whole, split, odd = self.words, [], {}, []
        for w in words:
            if w.isalpha() and w.isascii():
                whole.append(w)
            elif _plain.fullmatch(w) and "<|" not in w:
                split[w] = _parts.findall(w)
            else:
                odd.append(w)
        parts = list(set(chain(whole, *split.values())).difference(known))
        if parts:
            listed = [BETWEEN] * (2 * len(parts))
            listed[::2] = parts
            ids = np.array(self.bare.encode_batch_fast([listed], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            ends, flat, one = np.flatnonzero(ids == self.between) * self.kind.itemsize, ids.tobytes(), self.kind.itemsize
            known.update((p, flat[a:b]) for p, a, b in zip(parts, [0, *(ends[:-1] + one).tolist()], ends.tolist(), strict=True))
        known.update((w, b"".join([known[p] for p in ps])) for w, ps in split.items())
        found = self.whole.encode_batch_fast(odd, add_special_tokens=False)
        known.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(odd, found, strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last one's end)."""
        if len(self.words) > REMEMBERED:
            self.words = {}
        cut = pc.split_pattern(pc.replace_substring(pc.ascii_lower(pa.array(texts, pa.large_string())), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn([w for w in words if w not in self.words])
        own = [self.words[w] for w in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        flat, n = np.frombuffer(b"".join(own), self.kind), sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], n)]
        return ids, ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    """The tokenizer of a file: a path, or a name in the folder of public tokenizers; one for each worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return WordIds(name)


def _tokenised(name: str, window: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(name)
        one, end = coder.kind.itemsize, np.array([END], coder.kind)
        for doc_ids, texts in chunks(batches, CHUNK_CHARS):
            ids, ends = coder.encode([t or "" for t in texts])
            rows: list[tuple] = []
            for doc_id, a, b in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own, total = np.concatenate([ids[a:b], end]).tobytes(), b - a + 1
                rows += [(doc_id, at, min(window, total - at), total, own[at * one : (at + window) * one]) for at in range(0, total, window)]
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096], strict=True))
                kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def packed(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(piece, start in the piece, length)]) of pieces no longer than the longest tier.

    All sequences but one are as long as their tier.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    held = 0  # bit n: pieces of length n are free

    def put(length: int, piece: int, start: int) -> None:
        nonlocal held
        free.setdefault(length, []).append((piece, start))
        held |= 1 << length

    def take(length: int) -> tuple[int, int]:
        nonlocal held
        found = free[length].pop()
        if not free[length]:
            held ^= 1 << length
        return found

    for i, n in enumerate(lengths):
        put(n, i, 0)
    out = []
    for tier in sorted(tiers, reverse=True):
        below = max((t for t in tiers if t < tier), default=0)
        while (longest := (held & ((1 << tier + 1) - 1)).bit_length() - 1) > below:
            own, gap = [(*take(longest), longest)], tier - longest
            while gap:
                fits = (held & ((1 << gap + 1) - 1)).bit_length() - 1
                if fits > 0:
                    own.append((*take(fits), fits))
                    gap -= fits
                elif longer := held >> gap + 1:
                    n = gap + (longer & -longer).bit_length()
                    piece, start = take(n)
                    own.append((piece, start, gap))
                    put(n - gap, piece, start + gap)
                    gap = 0
                else:
                    break
            out.append((tier, own))
    return out


def stepped(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each sequence, by its padded length: the one with the fewest tokens so far, longest first."""
    steps = max(1, round(sum(lengths) / step_tokens))
    heap, found = [(0, s) for s in range(steps)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, s = heap[0]
        found[i] = s
        heapq.heapreplace(heap, (tokens + lengths[i], s))
    return found


def _padded(tokens: int, longest: int) -> int:
    return tokens if tokens & tokens - 1 == 0 else longest


def _packer(tiers: tuple[int, ...], step_tokens: int, one: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy(), kind="stable")  # however rows arrive, a group is packed alike
        table = table.take(pa.array(order))
        group = table.column("group")[0].as_py()
        starts, texts = table.column("start").to_pylist(), table.column("ids").to_pylist()
        sequences = packed(table.column("length").to_pylist(), tiers)
        used = [sum(n for _, _, n in own) for _, own in sequences]
        padded = [_padded(n, max(tiers)) for n in used]
        steps = stepped(padded, step_tokens)
        rows = []
        for k, (_, own) in enumerate(sequences):
            offset = 0
            for piece, start, length in own:
                ids = np.frombuffer(texts[piece], f"<u{one}", length, start * one).astype("<u4").tobytes()
                rows.append((piece, starts[piece] + start, length, ids, (group << SEQUENCE_BITS) + k, offset, padded[k], (group << SEQUENCE_BITS) + steps[k]))
                offset += length
        at, *cols = zip(*rows, strict=True)
        pieces = table.select(["doc_id", "doc_tokens"]).take(pa.array(at))
        names = ["start", "length", "ids", "sequence_id", "offset", "tier", "step_group"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        made = {n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)}
        return pa.table({"doc_id": pieces.column("doc_id"), **made, "doc_tokens": pieces.column("doc_tokens")})

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids, sequence_id, offset, tier, step_group, doc_tokens.

    start: the document's ids before the piece; ids: little-endian unsigned 32-bit; offset: the ids before it in its
    sequence; tier: the sequence's padded length (its own where that is a power of two, else the longest tier's);
    step_group: sequences that make a step, nearly alike in tokens. A null text is an empty one, and has the end id
    alone. Texts of any length are packed whole. Rows repeated with one doc_id (ties), and rows with a null id, are
    documents of their own, dealt to groups one by one. An empty table gives no rows; other columns are ignored, whatever
    their names. Tiers are powers of two.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, longest = docs.schema["doc_id"].dataType, max(tiers)
    name = kind.simpleString()
    tokens = docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, longest, to_arrow_type(kind)), f"doc_id {name}, start long, length long, doc_tokens long, ids binary")
    tokens = write_shared(tokens, "tokens")
    total, octets = tokens.agg(F.sum("length"), F.sum(F.octet_length("ids"))).first()
    groups, one = max(1, -(-(total or 0) // group_tokens)), (octets or 0) // (total or 1)
    place = F.monotonically_increasing_id()  # of a written table: the same whenever a task runs again
    dealt = tokens.withColumn("place", place).withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)))
    schema = f"doc_id {name}, start long, length long, ids binary, sequence_id long, offset long, tier int, step_group long, doc_tokens long"
    return dealt.groupBy("group").applyInArrow(_packer(tuple(tiers), step_tokens, one), schema)
