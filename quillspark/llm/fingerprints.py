"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo a prime, the hashes of all its prefixes; the hash of any span follows from two
entries. So spans are compared in constant time, and the longest common extension of two places is found by binary search.

A fingerprint is a string: length, the whole text's hash modulo two primes, and the ``KEEP`` least mixed hashes of its spans
of ``SPAN`` code points (shorter texts: the whole text as one span). Equal texts have equal fingerprints. The likeness of
two fingerprints estimates the Jaccard similarity of their span sets: the share of the least hashes of both that both hold.

Defined results: null texts are empty; empty texts are like each other (1) and unlike all others (0); rows that repeat a
doc_id, or have none, are documents of their own, in descending order of text among each other; a null doc_id comes last in
descending order; the only document of a table is its own next; an empty table gives an empty result; a text is hashed
whole, in about 50 bytes of arrays for each code point; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import shuffle_partitions
from quillspark.llm.suffix_dedup import numbered

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)
SPAN, KEEP = 16, 32


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


class Powers:
    """Powers of the bases and of their inverses, extended as longer texts come."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.up = [_powers(b, p, self.size) for b, p in zip(BASES, PRIMES, strict=True)]
            self.down = [_powers(pow(b, -1, p), p, self.size) for b, p in zip(BASES, PRIMES, strict=True)]


class PrefixHash:
    """Prefix arrays of a text modulo both primes."""

    def __init__(self, codes: np.ndarray, powers: Powers, shared: PrefixHash | None = None, same: int = 0):
        """codes: code points; shared: a hash of a text with the same first ``same`` code points, whose entries are taken over."""
        powers.grow(len(codes) + 1)
        self.codes, self.powers, self.sums = codes, powers, []
        tail = codes[same:].astype(np.uint64) + np.uint64(1)
        for k, prime in enumerate(PRIMES):
            begin = shared.sums[k][: same + 1] if shared is not None else np.zeros(1, np.uint64)
            terms = tail * powers.up[k][same : len(codes)] % np.uint64(prime)
            self.sums.append(np.concatenate([begin, (begin[-1] + np.cumsum(terms, dtype=np.uint64)) % np.uint64(prime)]))

    def __len__(self) -> int:
        return len(self.codes)

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The hash of a span, whatever its place."""
        return tuple((int(s[start + length]) - int(s[start])) * int(self.powers.down[k][start]) % PRIMES[k] for k, s in enumerate(self.sums))

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """The longest common extension of the place ``start`` here and ``at`` there."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, middle) == other.span(at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def least(self) -> np.ndarray:
        """The KEEP least mixed hashes of all spans of SPAN code points, sorted."""
        n = len(self)
        if not n:
            return np.empty(0, np.uint32)
        size = min(n, SPAN)
        s, prime = self.sums[0], np.uint64(PRIMES[0])
        spans = (s[size:] + prime - s[:-size]) * self.powers.down[0][: n - size + 1] % prime
        spans = (spans * np.uint64(0x9E3779B97F4A7C15) ^ (spans << np.uint64(21))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)
        found = spans if len(spans) <= 4 * KEEP else np.partition(spans, 4 * KEEP - 1)[: 4 * KEEP]
        found = np.unique(found)
        if len(found) < KEEP < len(spans):
            found = np.unique(spans)
        return found[:KEEP].astype(np.uint32)

    def fingerprint(self) -> str:
        return f"{len(self):x}-{int(self.sums[0][-1]):08x}{int(self.sums[1][-1]):08x}-{self.least().astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = ({part[k : k + 8] for k in range(0, len(part), 8)} for part in (a.rpartition("-")[2], b.rpartition("-")[2]))
    if not x or not y:
        return 0.0
    both = sorted(x | y)[:KEEP]
    return sum(h in x and h in y for h in both) / len(both)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


GROUP = 64


def _in_ranges(key: Column, cuts: list[int], pieces: int) -> Column:
    """A range number that falls as the key rises: between sorted cut points, then in ``pieces`` of equal width.

    The cut point is found in two steps, among every GROUP-th and then among those that follow it.
    """
    rows = [cuts[k : k + GROUP] for k in range(0, len(cuts), GROUP)]

    def longs(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<long>")

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= key))

    group = F.greatest(passed(longs([r[0] for r in rows])), F.lit(1))
    low = F.element_at(F.array(*map(longs, rows)), group)
    at = (group - 1) * GROUP + F.greatest(passed(low), F.lit(1))
    every = F.array(*[F.lit(float(c)) for c in [*cuts, cuts[-1] + 1]])  # doubles: differences can exceed a long
    begin, end = F.element_at(every, at.cast("int")), F.element_at(every, (at + 1).cast("int"))
    inner = F.floor((key.cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)) * pieces)
    inner = F.greatest(F.least(inner, F.lit(pieces - 1)), F.lit(0))
    return (-((at - 1) * pieces + inner)).cast("long")


def edited_fingerprints(docs: DataFrame, most_cuts: int = 4096) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and common_prefix.

    The next document in descending order of doc_id comes from the same partition: documents are dealt by ranges of
    doc_id (quantiles, ``most_cuts`` at most, cut further into equal widths where more are needed), and each range also gets
    a copy of the document that follows it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = numbered(docs, "id", repeats_are_one=False, nulls_first=True)
    parts = shuffle_partitions(spark)
    ids = docs.select("id")
    count = min(most_cuts, 4 * parts)
    found = ids.select(F.expr(f"percentile_approx(id, array({', '.join(str(k / count) for k in range(count))}), {10 * count})").alias("q"), F.min("id").alias("least")).first()  # a number for each range
    cut_points = [0] if found["least"] is None else sorted({found["least"], *found["q"]})
    part = _in_ranges(F.col("id"), cut_points, -(-4 * parts // count))
    firsts = sorted((r["part"], r["first"]) for r in ids.select(part.alias("part"), "id").groupBy("part").agg(F.max("id").alias("first")).collect())  # a row for each range
    follows = [(p, first) for (p, _), (_, first) in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    borders = spark.createDataFrame(follows, "part long, id long")  # a row for each range
    placed = docs.select("id", "doc_id", "text", part.alias("part"), F.lit(False).alias("copy"))
    copies = docs.join(F.broadcast(borders), "id").select("id", "doc_id", "text", "part", F.lit(True).alias("copy"))
    ordered = placed.unionByName(copies).repartition(2 * parts, "part").sortWithinPartitions("part", "copy", F.desc("id")).select("doc_id", "text", "part", "copy")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        before = None
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text, part, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                own = PrefixHash(code_points(text), powers)
                print_ = own.fingerprint()
                if before is not None and before[3] == part:
                    last_id, last, last_print, _, last_text = before
                    changed = edited(last_text, text)
                    kept = len(last) - len(last) // 2
                    other = PrefixHash(code_points(changed), powers, last, kept)
                    other_print = other.fingerprint()
                    out.append((last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), last_print, other_print, likeness(last_print, other_print), likeness(last_print, print_), last.extension(0, other, 0)))
                before = None if copy else (doc_id, own, print_, part, text)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return ordered.mapInArrow(hashed, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")
