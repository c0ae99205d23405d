"""Language identification by cross-parsing entropy.

For each language a suffix automaton recognises every substring of a sample of its labelled text. A text is parsed from
left to right into phrases, each the longest string that occurs in the sample; a language in which the text needs few
phrases has seen most of it. Phrases are normalised by the information each takes, log2 of the sample's length, over the
text's length; the least wins. The score is the winner's lead: 1 - least / next.

Texts are folded to lower-case letters with one space between words, as UTF-8 bytes, so that every letter of every script
counts. Bytes that no sample holds are one symbol.

All automata are one dense table (state, symbol) -> state, so that many texts step through all languages at once with one
array operation a byte. Long texts are parsed in stretches side by side. A stretch first starts a phrase of its own; then
the state in which the one before ends is followed into it, until both readings are in the same state, and the difference
of their phrases is made good. So the phrases are those of one parse of the whole text.

A language is learned from ``sample`` bytes of pieces of ``piece`` characters: all labelled texts are cut into pieces, and
those with the least hashes of their own text are taken, wherever they stand and whatever their doc_id. Languages are few by
nature, and their number bounds the table: states of at most twice the sample, and a column for each byte that is in use.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, as is every text if there is
nothing to learn from; ties go to the language that sorts first; with one language its score is 1; texts of any length are
read whole; repeated rows get equal results; an empty table gives an empty result; only text and the columns to keep are read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.base import by_value


_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> bytes:
    """Lower-case words of letters, one space between them, as UTF-8."""
    words = _WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):  # numbers that aren't digits
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return " ".join(words).encode("utf-8", "surrogatepass")


def suffix_automaton(symbols: bytes, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a string over symbols below width: (state, symbol) -> state, -1 for none; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.full((len(step), width), -1, np.int32)
    for state, edges in enumerate(step):
        if edges:
            table[state, list(edges)] = list(edges.values())
    return table


@dataclass
class CrossParser:
    languages: list[str]
    #: A byte's symbol: 0 a space, 1 a byte that no sample holds.
    codes: bytes
    width: int
    #: All languages' transitions; missing ones lead to -1.
    table: np.ndarray
    #: Each language's start state, and the bits that a phrase takes.
    starts: np.ndarray
    bits: np.ndarray
    stretch: int = 2048

    @classmethod
    def learn(cls, samples: dict[str, list[str]], sample: int = 16_000) -> CrossParser:
        held = {language: b" ".join(filter(None, map(folded, samples[language])))[:sample] for language in sorted(samples)}
        used = sorted({byte for text in held.values() for byte in text} - {32})
        codes = bytearray([1] * 256)
        codes[32] = 0
        for k, byte in enumerate(used):
            codes[byte] = k + 2
        tables, starts, bits, names = [], [], [], []
        at, width = 0, len(used) + 2
        for language, text in held.items():
            if not text:
                continue
            one = suffix_automaton(text.translate(codes), width)
            tables.append(np.where(one >= 0, one + at, -1).astype(np.int32))
            names.append(language)
            starts.append(at)
            bits.append(math.log2(len(text) + 1))
            at += len(one)
        table = np.concatenate(tables) if tables else np.empty((0, width), np.int32)
        return cls(names, bytes(codes), width, table.ravel(), np.array(starts, np.int64), np.array(bits))

    def encode(self, text: str) -> bytes:
        return folded(text).translate(self.codes)

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Bits a symbol for each encoded text and language."""
        owner, sizes = [], []
        for k, t in enumerate(texts):
            parts = max(1, -(-len(t) // self.stretch))
            owner += [k] * parts
            sizes += [self.stretch] * (parts - 1) + [len(t) - (parts - 1) * self.stretch]
        owner, sizes = np.array(owner), np.array(sizes, np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum(sizes) - sizes
        n = len(self.languages)
        count = np.zeros((n, len(owner)), np.int64)
        end = np.zeros((n, len(owner)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            count[:, part], end[:, part] = self._parse(flat, offsets[part], sizes[part])
        self._join(flat, offsets, sizes, owner, count, end)
        phrases = np.zeros((n, len(texts)))
        np.add.at(phrases, (slice(None), owner), count)
        lengths = np.array([max(1, len(t)) for t in texts])
        return (phrases * self.bits[:, None] / lengths).T

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after a symbol, whether it begins a phrase) for each language and lane."""
        after = self.table.take(state * self.width + symbols).astype(np.int64)
        missing = after < 0  # a phrase ends, and the next starts with this symbol
        begins = missing | (state == self.starts[:, None])
        return np.where(missing, self._fresh[:, symbols], after), begins

    @cached_property
    def _fresh(self) -> np.ndarray:
        """For each language the state after the first symbol of a phrase."""
        fresh = self.table.reshape(-1, self.width)[self.starts].astype(np.int64)
        return np.where(fresh >= 0, fresh, self.starts[:, None])

    def _parse(self, flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, state at the end) for each language and lane, from the start state; lanes in descending order of size."""
        state = np.repeat(self.starts[:, None], len(sizes), 1)
        count = np.zeros(state.shape, np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(sizes), longest), np.uint8)
        for k, (a, n) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True)):
            grid[k, :n] = flat[a : a + n]
        grid = grid.T.astype(np.int64)
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than t
        for t in range(longest):
            m = active[t]
            state[:, :m], begins = self._step(state[:, :m], grid[t, :m])
            count[:, :m] += begins
        return count, state

    def _join(self, flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, owner: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
        """Mend count and end of stretches that began as if a phrase began there."""
        begun = np.repeat(self.starts[:, None], len(owner), 1)  # the states that count and end come from
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        while len(follows):
            lanes = follows[(end[:, follows - 1] != begun[:, follows]).any(0)]
            if not len(lanes):
                return
            was, now = begun[:, lanes], end[:, lanes - 1]
            begun[:, lanes] = now
            t = 0
            while len(lanes):
                symbols = flat[offsets[lanes] + t].astype(np.int64)
                was, took = self._step(was, symbols)
                now, takes = self._step(now, symbols)
                count[:, lanes] += takes.astype(np.int64) - took
                t += 1
                over = sizes[lanes] == t
                if over.any():
                    end[:, lanes[over]] = now[:, over]
                open_ = ~over & (was != now).any(0)
                if not open_.all():
                    lanes, was, now = lanes[open_], was[:, open_], now[:, open_]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [self.encode(t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [k for k, c in enumerate(coded) if c]
        if self.languages and known:
            bits = self.entropies([coded[k] for k in known])
            best = bits.argmin(1)
            least = bits[np.arange(len(known)), best]
            if len(self.languages) > 1:
                following = np.partition(bits, 1, 1)[:, 1]
                lead = np.where(following > 0, 1 - least / np.where(following > 0, following, 1), 0.0)
            else:
                lead = np.ones(len(known))
            for k, b, s in zip(known, best.tolist(), lead.tolist(), strict=True):
                names[k], scores[k] = self.languages[b], min(1.0, max(0.0, s))
        return names, scores


def learn(docs: DataFrame, sample: int = 16_000, piece: int = 256) -> CrossParser:
    """docs (text, lang), the rows to learn from -> parser."""
    texts = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's different pieces of least hash, for each language about as many as make up the sample."""
        held: dict[str, list] = {}  # a heap of (-hash, piece), the largest hash first, and its characters
        seen: dict[str, set[int]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                heap, own = held.setdefault(lang, []), seen.setdefault(lang, set())
                for a in range(0, len(text), piece):
                    part = text[a : a + piece]
                    h = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                    full = size.get(lang, 0) >= 2 * sample
                    if full and h >= -heap[0][0] or h in own:
                        continue
                    letters = len(folded(part))
                    if not letters:
                        continue
                    heappush(heap, (-h, part))
                    own.add(h)
                    size[lang] = size.get(lang, 0) + letters
                    while size[lang] - (dropped := len(folded(heap[0][1]))) >= 2 * sample:
                        own.discard(-heappop(heap)[0])
                        size[lang] -= dropped
        rows = [(lang, -h, part) for lang, heap in held.items() for h, part in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["lang", "hash", "piece"])

    pieces = texts.mapInArrow(least, "lang string, hash long, piece string").groupBy("lang", "hash").agg(F.min("piece").alias("piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("lang").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))  # a few rows for each task
    chosen = pieces.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < 2 * sample).drop("before")
    samples: dict[str, list[str]] = {}
    for row in chosen.sort("lang", "hash").collect():  # about twice the sample for each language
        samples.setdefault(row["lang"], []).append(row["piece"])
    return CrossParser.learn(samples, sample)


def predict(docs: DataFrame, parser: CrossParser, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(by_value(parser))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            size, a = 0, 0
            for b in range(len(batch)):
                size += len(batch.column(0)[b].as_py() or "")
                if size > 4 << 20 or b == len(batch) - 1:
                    part = batch.slice(a, b + 1 - a)
                    names, scores = own.predict([t or "" for t in part.column(0).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names), pa.array(scores)], [*keep, "lang_pred", "score"])
                    a, size = b + 1, 0

    return docs.select(F.col("text").cast("string").alias("text"), *keep).mapInArrow(predicted, schema)
