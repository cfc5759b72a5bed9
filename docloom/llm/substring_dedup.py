"""Substring dedup by sliding sentence spans.

Every sentence begins a run: RUN consecutive sentences, and more until they have MIN_WORDS words. Runs are
hashed to 128 bits and ranked globally by their hash; the first place (by doc_id, then position) keeps its text, and every sentence that another
place of a repeated run covers is removed. A sentence longer than PIECE words counts as several, cut at words
that only the words around them choose, so that two copies of a passage are cut alike wherever it begins.

A passage of 51 words always holds a run: with windows of PIECE - 1 = 10 words, its copies have the same cuts
from word 10 to word 41, the first of them at 19 at most and the last at 32 at least (or at the ends of short
sentences, which are nearer to its ends), with MIN_WORDS words and so two units between them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import chunks, sha256_hex

#: Sentences of a run at least, words at least, and words of a sentence that isn't cut.
RUN, MIN_WORDS, PIECE = 2, 12, 11
_end = re.compile(r"[.!?]+(?=\s)|\n+")
_word = re.compile(r"\S+")
#: Scripts without blanks between words (Thai to Lao, Myanmar, Khmer, kana, Han): each character counts as a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_alone = re.compile(f"[{_ALONE}]")
_word_or_character = re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")


def _lower(text: str) -> str:
    """Lower-cases A-Z alone."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def content_cuts(words: list[str], window: int) -> list[int]:
    """Places of 1 to len(words) - 1 whose word, A-Z lower-cased, has the least hash of some `window` places in a row, the last of equal ones."""
    hashes = list(map(zlib.crc32, " ".join(words).encode("utf-8", "surrogatepass").lower().split(b" ")))
    out, at, least = [], 0, -1
    for last in range(window, len(hashes)):
        if at <= last - window:  # it left the window
            part = hashes[last : last - window : -1]
            least = min(part)
            at = last - part.index(least)
        elif hashes[last] <= least:
            at, least = last, hashes[last]
        else:
            continue
        out.append(at)
    return out


def sentences(text: str | None, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences that tile the text; blanks after one belong to it."""
    if not text:
        return []
    word = _word_or_character if not text.isascii() and _alone.search(text) else _word
    cuts = [m.end() for m in _end.finditer(text)]
    out: list[tuple[int, int, int]] = []
    start = 0
    for end in [*cuts, len(text)]:
        words = text[start:end].split() if word is _word else word.findall(text, start, end)
        if not words:
            continue  # blanks go to the next sentence
        if len(words) > piece:
            places = content_cuts(words, max(1, piece - 1))
            lead = len(text[start:end]) - len(text[start:end].lstrip())
            if len(" ".join(words)) == len(text[start:end].strip()) and word is _word:  # one blank between words
                begins = [start + lead + n + i for i, n in enumerate(accumulate(map(len, words), initial=0))]
            else:
                begins = [m.start() for m in word.finditer(text, start, end)]
            starts = [start, *(begins[i] for i in places), end]
            out += zip(starts[:-1], starts[1:], [b - a for a, b in zip([0, *places], [*places, len(words)], strict=True)], strict=True)
        else:
            out.append((start, end, len(words)))
        start = end
    if out and start < len(text):
        out[-1] = (out[-1][0], len(text), out[-1][2])
    return out


def run_ends(found: list[tuple[int, int, int]], run: int = RUN, min_words: int = MIN_WORDS) -> list[int]:
    """For each sentence that begins a run, the place after its last: `run` sentences, and more until they have min_words words."""
    out, end, words = [], 0, 0
    for i in range(len(found)):
        while end < len(found) and (end - i < run or words < min_words):
            words += found[end][2]
            end += 1
        if end - i < run or words < min_words:
            break
        out.append(end)
        words -= found[i][2]
    return out


def runs(text: str | None, run: int = RUN, min_words: int = MIN_WORDS, piece: int = PIECE) -> list[tuple[int, bytes]]:
    """(place, hash) of the run that each sentence begins; blanks and the case of A-Z don't matter."""
    found = sentences(text, piece)
    ends = run_ends(found, run, min_words)
    if not ends:
        return []
    low = _lower(text)
    words = _word_or_character.findall(low) if not low.isascii() and _alone.search(low) else low.split()
    at = [0]
    for *_, n in found:
        at.append(at[-1] + n)
    return [(i, xxhash.xxh3_128_digest(" ".join(words[at[i] : at[end]]).encode("utf-8", "surrogatepass"))) for i, end in enumerate(ends)]


#: A run that HOT_SAMPLED documents have among one of SAMPLE is hot: its rows are dealt to SALTS tasks first. HOT_RUNS are known at most.
SAMPLE, HOT_SAMPLED, HOT_RUNS, SALTS = 64, 8, 100_000, 64


def hot_runs(texts: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, piece: int = PIECE) -> frozenset[bytes]:
    """Hashes of runs that are probably hot, from documents chosen by their id; the result of dedup() doesn't depend on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in chunks(batches, columns=("text",)):
            held = Counter(d for t in texts for d in {d for _, d in runs(t, run, min_words, piece)})
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["h", "n"])

    sample = texts.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(count, "h binary, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_SAMPLED)
    return frozenset(bytes(r["h"]) for r in counted.orderBy(F.desc("n"), "h").limit(HOT_RUNS).collect())


#: Places of one run.
LATER = "array<struct<id:long,place:int>>"


def repeated_places(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, piece: int = PIECE) -> DataFrame:
    """(id, places): for each document with runs that occur earlier, the places of those runs."""
    others = pa.list_(pa.struct([("id", pa.int64()), ("place", pa.int32())]))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = docs.sparkSession.sparkContext.broadcast(hot_runs(texts, run, min_words, piece))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            # a frequent run sends a row for each chunk: its first place, and the others beside it
            held: dict[bytes, set[tuple[int, int]] | tuple[int, int]] = {}
            for doc, text in zip(ids, texts, strict=True):
                for place, digest in runs(text, run, min_words, piece):
                    own = held.setdefault(digest, (doc, place))
                    if isinstance(own, set):
                        own.add((doc, place))
                    elif own != (doc, place):
                        held[digest] = {own, (doc, place)}
            halves = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
            first = [min(v) if isinstance(v, set) else v for v in held.values()]
            salt = 1 + xxhash.xxh32_intdigest(repr(ids[0])) % SALTS
            salts = [salt if d in hot.value else 0 for d in held]
            more = [[{"id": i, "place": p} for i, p in v if (i, p) != f] if isinstance(v, set) else None for v, f in zip(held.values(), first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([i for i, _ in first], pa.int64()), pa.array([p for _, p in first], pa.int32()), pa.array(salts, pa.int32()), pa.array(more, others)], ["h1", "h2", "id", "place", "salt", "more"])

    spans = texts.mapInArrow(hashes, f"h1 long, h2 long, id long, place int, salt int, more {LATER}")
    # one shuffle of all and no join: rows of rank 1 are the first place, and places beside it are later
    ranked = spans.withColumn("n", F.rank().over(Window.partitionBy("h1", "h2", "salt").orderBy("id", "place"))).filter("n > 1 OR more IS NOT NULL OR salt > 0")
    # the first places of a hot run, one for each salt, meet once more; every other row stands alone
    alone = F.when((F.col("salt") > 0) & (F.col("n") == 1), F.lit(0)).otherwise(F.xxhash64("id", "place", "salt"))
    ranked = ranked.withColumn("alone", alone).withColumn("m", F.rank().over(Window.partitionBy("h1", "h2", "alone").orderBy("id", "place")))
    own = F.when((F.col("n") > 1) | ((F.col("alone") == 0) & (F.col("m") > 1)), F.array(F.struct("id", "place")))
    later = ranked.select(F.explode(F.concat(F.coalesce(own, F.array().cast(LATER)), F.coalesce("more", F.array().cast(LATER)))).alias("p")).select("p.*")
    return later.groupBy("id").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, piece: int = PIECE) -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, n_removed, removed (start:end, comma-joined code points), text_sha256, text.

    text is what is left; null stays null with no sentences. Rows of one doc_id are one place: repeated rows
    lose the same sentences, and keep theirs where the document is the first. Rows with a null doc_id are left
    as they are. Texts of any length are cut and read whole; of equal places the smallest (doc_id, position) keeps its
    text. doc_id must be an integer; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    places = repeated_places(docs, run, min_words, piece)
    joined = docs.select("doc_id", "text").join(places, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "places")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sentences(text, piece)
                ends = run_ends(found, run, min_words) if own else []
                gone = sorted({j for p in own or () for j in range(p, ends[p])})
                out = set(gone)
                kept = text if not gone else "".join(text[a:b] for j, (a, b, _) in enumerate(found) if j not in out)
                rows.append((len(found), len(gone), ",".join(f"{found[j][0]}:{found[j][1]}" for j in gone), sha256_hex(kept or ""), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 3, strict=True))], ["doc_id", "n_sentences", "n_removed", "removed", "text_sha256", "text"])

    return joined.mapInArrow(remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_sentences long, n_removed long, removed string, text_sha256 string, text string")
