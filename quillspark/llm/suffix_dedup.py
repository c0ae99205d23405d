"""Removal of byte strings of ``length`` bytes that also start earlier in the corpus, by sorted suffixes.

All windows of ``length`` bytes are compared without shuffling a suffix for each byte:

1. Each window has an anchor, its leftmost k-gram of least hash. Equal windows have the same anchor at the same offset, so
   windows are grouped by their anchor's hash. A run of windows with one anchor is a segment; there are about 35 times
   fewer segments than bytes.
2. Anchor hashes are counted by a grouped aggregate, and segments whose anchor is unique in the corpus are dropped by a
   join (skewed keys are split by the sort-merge join); nothing in them can repeat.
3. The text of the remaining segments goes to the bucket of its anchor. Of equal segments in one block of documents only
   the first is sent. Windows of an anchor with more than ``hot`` segments are dealt out one by one by their own hash
   instead, so that a passage that very many documents hold is spread and combined before the shuffle.
4. In a bucket, the suffixes that start at the anchors, and the reversed texts before them, are put in order by
   deep-shallow sorting: multikey quicksort on words down to a shallow depth, then a blind trie for each group that is
   still tied. With the longest common prefixes of neighbours, two windows with their anchors at offset ``o`` are equal
   if the suffixes agree on ``length - o`` bytes and the texts before on ``o``. Of equal windows all but the first in
   order of (doc_id, start) are marked.
5. Marked windows come back to their documents as runs, which are merged and cut out of the text.

Matches are decided on the bytes themselves; hashes only choose groups. Defined results: null texts are empty; texts
shorter than ``length`` bytes stay whole; a null doc_id orders after all others, and rows without one are documents of
their own, in order of their text; rows that repeat a doc_id are documents of their own too, in order of their text, but
those that repeat its text as well count as one document (a string at the same start is not an earlier one); other
columns stay, whatever their names; an empty table gives an empty result; a text of any length is anchored block by block
and sent segment by segment.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.base import fresh, materialize, shuffle_partitions
from quillspark.llm.shingles import blocks, mixed

GRAM = 32
LAST_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 22) - 1)


class Anchors:
    """Segments of windows with one anchor, for many texts at once."""

    def __init__(self, length: int, block: int = 1 << 20):
        self.length, self.block = length, block
        self.value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        n = block + 2 * length
        self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, start of the segment, windows in it, bytes before the anchor, hash of the anchor), several times."""
        pieces, room = [], self.block
        for k, text in enumerate(texts):
            for start in range(0, max(1, len(text) - self.length + 1), self.block):
                piece = text[start : start + self.block + self.length - 1] if len(text) > self.block else text
                if pieces and len(piece) > room:
                    yield self._block(pieces)
                    pieces, room = [], self.block
                pieces.append((k, start, piece))
                room -= len(piece)
        if pieces:
            yield self._block(pieces)

    def _block(self, pieces):
        raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        lengths = np.array([len(p[2]) for p in pieces], np.int64)
        starts = np.cumsum(lengths) - lengths
        if len(raw) < self.length:
            none = np.empty(0, np.int64)
            return none, none, none, none, np.empty(0, np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(self.value[raw] * self.powers[: len(raw)], dtype=np.uint64))
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: len(raw) - GRAM + 1])
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        span, have = self.length - GRAM + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: -(span - have)], least[span - have :])
        anchor = (least & _LOW).astype(np.int64)  # of the window at each place
        room = np.maximum(0, lengths - self.length + 1)
        windows = np.repeat(starts - (np.cumsum(room) - room), room) + np.arange(room.sum())
        anchor = anchor[windows]
        if not len(windows):
            none = np.empty(0, np.int64)
            return none, none, none, none, np.empty(0, np.uint64)
        first = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        count = np.diff(np.append(first, len(anchor)))
        piece = np.searchsorted(starts + lengths, windows[first], side="right")
        number, offset = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
        return number[piece], windows[first] - starts[piece] + offset[piece], count, anchor[first] - windows[first], grams[anchor[first]]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders strings that share long prefixes: it branches on single bytes and skips what lies between them.

    A node is [depth, {byte or -1 at the end: node or leaf}], a leaf a list of equal strings' numbers.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = (number, [number])
            return
        node = self.root
        while isinstance(node, list):
            branches = node[1]
            node = branches.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(branches.values()))
        other = self.strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node[1].append(number)
            return
        mine, theirs = (x[shared] if shared < len(x) else -1 for x in (s, other))
        above, at, node = None, None, self.root
        while isinstance(node, list) and node[0] < shared:
            above, at = node, s[node[0]] if node[0] < len(s) else -1
            node = above[1][at]
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = (number, [number])
            return
        split = [shared, {theirs: node, mine: (number, [number])}]
        if above is None:
            self.root = split
        else:
            above[1][at] = split

    def ordered(self) -> Iterator[int]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield from node[1]


def deep_shallow(strings: list[bytes], words: int = 4, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the strings' numbers in order, and for each place the common prefix with the place before (0 at first).

    Multikey quicksort takes 8 bytes as one key, down to ``words`` keys; groups still tied go through a blind trie.
    """
    n = len(strings)
    packed = np.frombuffer(b"".join(s[: 8 * words].ljust(8 * words, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(n, words)
    order: list[int] = []

    def deep(group: list[int]) -> None:
        if len(group) == 1:
            order.append(group[0])
            return
        trie = BlindTrie(strings)
        for number in group:
            trie.insert(number)
        order.extend(trie.ordered())

    todo = [(np.arange(n), 0)] if n else []
    while todo:
        group, depth = todo.pop()
        if depth == words:
            deep(group.tolist())
        elif len(group) == 1:
            order.append(int(group[0]))
        elif len(group) <= small:
            keyed = sorted((tuple(packed[g].tolist()), g) for g in group.tolist())
            a = 0
            for b in range(1, len(keyed) + 1):
                if b == len(keyed) or keyed[b][0] != keyed[a][0]:
                    deep([g for _, g in keyed[a:b]])
                    a = b
        else:
            keys = packed[group, depth]
            pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
            below, above = keys < pivot, keys > pivot
            parts = [(group[below], depth), (group[~(below | above)], depth + 1), (group[above], depth)]
            todo += [part for part in reversed(parts) if len(part[0])]
    lcp = np.array([0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))][:n], np.int64)
    return np.array(order, np.int64), lcp


def mark_repeats(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, before: np.ndarray, text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that equal an earlier one among these segments."""
    marked_doc, marked_start = [], []
    order = np.lexsort((start, doc))
    seen: dict[tuple, tuple] = {}
    first: list[int] = []
    for k in order.tolist():
        at = (int(before[k]), text[k])
        if at not in seen:
            seen[at] = (doc[k], start[k])
            first.append(k)
        elif seen[at] != (doc[k], start[k]):  # a repeated row is no repeat
            marked_doc.append(np.full(windows[k], doc[k]))
            marked_start.append(start[k] + np.arange(windows[k]))
    grams = [text[k][before[k] : before[k] + GRAM] for k in first]
    number = Counter(grams)
    first = np.array([k for k, gram in zip(first, grams, strict=True) if number[gram] > 1], np.int64)
    if len(first):
        rank_after, lcp_after = _ranks([text[k][before[k] :] for k in first.tolist()])
        rank_before, lcp_before = _ranks([text[k][: before[k]][::-1] for k in first.tolist()])
        high = before[first]
        low = high - windows[first] + 1
        # In order of (doc, anchor's place): the same offset means the same order of windows.
        in_order = np.lexsort((start[first] + high, doc[first]))
        for o in range(int(low.min()), int(high.max()) + 1):
            own = in_order[(low[in_order] <= o) & (o <= high[in_order])]
            after = np.cumsum(lcp_after < length - o)[rank_after[own]]
            ahead = np.cumsum(lcp_before < o)[rank_before[own]]
            _, earliest, group = np.unique(after * (len(first) + 1) + ahead, return_index=True, return_inverse=True)
            place_doc, place = doc[first[own]], start[first[own]] + high[own] - o
            again = (place_doc != place_doc[earliest][group]) | (place != place[earliest][group])
            marked_doc.append(place_doc[again])
            marked_start.append(place[again])
    if not marked_doc:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(marked_doc), np.concatenate(marked_start)


def _ranks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    order, lcp = deep_shallow(strings)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, lcp


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows (bucket -1, doc, packed int64 pairs of run start and end), a row for each document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    opens = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1
    owner, pairs = doc[first], np.stack([start[first], start[last] + length], 1) if len(first) else np.empty((0, 2), np.int64)
    edges = np.append(0, np.flatnonzero(np.diff(owner)) + 1) if len(owner) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(owner)) if len(owner) else edges
    packed = [pairs[a:b].tobytes() for a, b in zip(edges.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([-1] * len(edges), pa.int32()), pa.array(owner[edges] if len(edges) else [], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "id", "packed"])


def numbered(docs: DataFrame, name: str, text: str = "text", doc_id: str = "doc_id", repeats_are_one: bool = True, nulls_first: bool = False) -> DataFrame:
    """docs with a column ``name``, not null: a long for each document, in order of (doc_id, text); null doc_ids last or first.

    It is doc_id itself where no two rows share one (a null counts as the largest or least long). Otherwise the rows are
    sorted, numbered and written to the shared folder. With ``repeats_are_one``, rows of the same doc_id (not null) and text
    share a number.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-LAST_ID - 1 if nulls_first else LAST_ID))
    if docs.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn(name, key)
    own, string, tie = fresh(docs.columns, "key", "string", "tie")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            numbers = []
            keys, texts = (batch.column(k) for k in (batch.num_columns - 2, batch.num_columns - 1))
            for key, held in zip(keys.to_pylist(), texts, strict=True):
                this = (key, held.as_py() or "")
                if not repeats_are_one or key is None or this != last:
                    now += 1
                last = this
                numbers.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(numbers, pa.int64())], [*batch.schema.names[:-2], name])

    # Ties among rows that are documents of their own are split, so that very many equal rows don't share a task.
    alone = F.col(own).isNull() if repeats_are_one else F.lit(True)
    keyed = docs.withColumn(own, F.col(doc_id).cast("long")).withColumn(string, F.col(text).cast("string"))
    by_key = F.col(own).asc_nulls_first() if nulls_first else F.col(own).asc_nulls_last()
    ordered = keyed.withColumn(tie, F.when(alone, F.monotonically_increasing_id())).orderBy(by_key, F.coalesce(string, F.lit("")), tie).drop(tie)
    return materialize(ordered.mapInArrow(number, StructType([*docs.schema.fields, StructField(name, LongType())])))


def repeated_runs(docs: DataFrame, length: int = 100, hot: int = 2000) -> DataFrame:
    """docs (id, not null, text, and others) -> (id, runs): for each document with repeats, arrays of packed (start, end) byte pairs."""
    spark = docs.sparkSession
    parts = 2 * shuffle_partitions(spark)
    buckets = parts

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length)
        for ids, texts in blocks(batches):
            ids = np.array(ids, np.int64)
            for number, start, windows, before, anchor in finder.of(texts):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[number]), pa.array(start << 16 | windows << 8 | before)], ["anchor", "id", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        held: list[tuple] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: (x[0], x[1]))
            seen: dict[tuple, tuple] = {}
            again: list[tuple] = []
            by_bucket: dict[int, list] = {}
            for x in held:
                doc, start, windows, before, text, alone = x
                if (was := seen.setdefault((before, text), (doc, start))) != (doc, start):
                    again.append((doc, start, windows))
                    continue
                own = text if alone else text[before : before + GRAM]
                by_bucket.setdefault(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little") % buckets, []).append(x)
            if again:
                owner = np.repeat([x[0] for x in again], [x[2] for x in again])
                yield _runs(owner, np.concatenate([x[1] + np.arange(x[2]) for x in again]), length)
            names, ids, blobs = [], [], []
            for bucket, xs in by_bucket.items():
                numbers = np.array([x[:4] for x in xs], np.int64).T
                names.append(bucket)
                ids.append(None)
                blobs.append(pack.compress(np.int64(len(xs)).tobytes() + numbers.tobytes() + b"".join(x[4] for x in xs)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "id", "packed"])

        for batch in batches:
            for doc, text, segments in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                for at in segments.as_py():
                    start, windows, before = at >> 17, at >> 9 & 255, at >> 1 & 255
                    if at & 1:
                        for k in range(windows):
                            held.append((doc, start + k, 1, before - k, raw[start + k : start + k + length], True))
                            size += length
                    else:
                        held.append((doc, start, windows, before, raw[start : start + windows + length - 1], False))
                        size += windows + length
                if size > 8 << 20:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        now, held = None, []

        def marked() -> pa.RecordBatch:
            numbers, texts = [], []
            for blob in held:
                raw = unpack.decompress(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                rows = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)
                ends = 8 + 32 * n + np.cumsum(rows[2] + length - 1)
                texts += [raw[a:b] for a, b in zip(np.append(8 + 32 * n, ends[:-1]).tolist(), ends.tolist(), strict=True)]
                numbers.append(rows)
            return _runs(*mark_repeats(*np.concatenate(numbers, 1), texts, length), length)

        for batch in batches:
            runs = batch.filter(pa.compute.equal(batch.column(0), -1))
            if len(runs):
                yield runs
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket == -1:
                    continue
                if bucket != now and held:
                    yield marked()
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield marked()

    every = docs.select("id", "text").mapInArrow(anchors, "anchor long, id long, at long")
    # Written out, so that the join reads both sides from exchanges and AQE can split a key that very many segments hold.
    repeated = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    at = F.shiftleft("at", 1) + F.when(F.col("n") > hot, 1).otherwise(0)
    segments = every.join(repeated, "anchor").select("id", at.alias("at")).groupBy("id").agg(F.collect_list("at").alias("segments"))
    schema = "bucket int, id long, packed binary"
    # All columns are read, so that this join and that of without_repeats share one exchange of the documents.
    sent = docs.join(segments, "id").select("id", "text", "segments", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")).mapInArrow(cut, schema)
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sorted_ = sent.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(sort, schema)
    return sorted_.groupBy("id").agg(F.collect_list("packed").alias("runs"))


def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, packed in zip(texts, runs, strict=True):
        raw = (text or "").encode()
        kept, removed, spans, at = [], 0, 0, 0
        if packed is not None and len(packed):
            pairs = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            last = -1
            for a, b in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
                a, b = min(a, len(raw)), min(b, len(raw))
                if a > last and b > a:
                    spans += 1
                if a > at:
                    kept.append(raw[at:a])
                if b > at:
                    removed += b - max(a, at)
                    at = b
                last = max(last, b)
        kept.append(raw[at:])
        out.append((len(raw), removed, spans, b"".join(kept)))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def _cut_out(text: Column, runs: Column) -> Column:
    """A struct (n_bytes, n_removed, n_spans, kept)."""
    return F.pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept binary")(text, runs)


def kept_text(text: Column, runs: Column) -> Column:
    """The text that is left; bytes of characters that a cut went through are dropped, and a text without runs stays as it is."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, runs: pd.Series) -> pd.Series:
        cut = _cut(texts, runs)
        return pd.Series([t if not n else k.decode("utf-8", "ignore") for t, n, k in zip(texts, cut["n_removed"], cut["kept"], strict=True)], dtype=object)

    return left(text, runs)


@dataclass
class Repeats:
    """frame: id, text, runs and the other columns by names of its own; columns: what restores the input's columns from it."""

    frame: DataFrame
    columns: dict[str, Column]

    @property
    def cut(self) -> Column:
        """A struct (n_bytes, n_removed, n_spans, kept)."""
        return _cut_out(F.col("text"), F.col("runs"))

    @property
    def kept_text(self) -> Column:
        return kept_text(F.col("text"), F.col("runs"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100) -> Repeats:
    """Each row of docs with the byte runs to take out of its text."""
    [name] = fresh(docs.columns, "id")
    keyed = numbered(docs, name, text, doc_id)
    # Names of our own, so that none of the input's can clash with them.
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text}
    renamed = keyed.select(F.col(name).alias("id"), F.col(text).cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in others.items()])
    columns = {c: F.col(others.get(c, "text")).alias(c) for c in docs.columns}
    return Repeats(renamed.join(repeated_runs(renamed, length), "id", "left"), columns)
