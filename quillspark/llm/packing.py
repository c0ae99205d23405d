"""Best-fit packing of tokenized documents into sequences of fixed capacity, in bulk-synchronous rounds.

A document's ids are cut into pieces only if they exceed the capacity: the first piece takes the remainder, the rest are
full. Full pieces are sequences of their own. The others are packed best-fit:

* Pieces are range-sorted by size, which gives each its rank. Pieces and gaps of one size are kept as runs (size, first
  rank or sequence, count), so that a size that holds a third of the pieces is one row of a round.
* A round deals pieces and gaps out by ranges of size; a gap goes to the range of its successor, the largest unplaced
  piece that fits it. A task sweeps its range: pieces in descending order take the smallest gap that holds them, equal
  ones by rank. What is left of the gaps goes to the next round.
* Where no gap holds any piece, the round opens sequences for the largest pieces: one for each piece over half the
  capacity, and else as many as the sizes that are left fill at least.
* Rounds end when all runs are placed: each places pieces, moves gaps to lower ranges or opens sequences. The result is a
  table of (size, ranks) -> (sequences, offset), to which pieces are joined by size and rank.

Defined results: null and empty texts are one piece that holds only the end-of-text id; an empty table gives an empty
result; repeated rows are packed one by one; null doc_ids are packed like others; a text of any length is cut into as many
pieces as it needs; other columns aren't read. Which of equal pieces goes where may differ from run to run.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import drop_materialized, materialize, range_prefix
from quillspark.llm.shingles import mixed

END_OF_TEXT = b"<|endoftext|>"


class ByteBpe:
    """Token ids of the byte-level BPE in a tokenizers file, for many texts at once.

    Its pre-tokens start before each space that no white space follows, so a text's ids are those of the parts between
    such spaces. Parts recur: a block's parts are told apart by a 64-bit hash from prefix sums and only those not known yet
    are encoded, joined into one string. Every part's bytes are then compared with those that its hash stands for, and
    the few that differ are encoded by themselves. ranks: the same vocabulary as tiktoken ranks, which encode faster.
    Texts that hold the special token's string, and texts over ``block`` bytes, go to the encoder whole; the ids are the
    same either way.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, block: int = 1 << 20, memory: int = 500_000):
        import numpy as np
        from tokenizers import Tokenizer

        self.special = Tokenizer.from_file(path)
        self.block, self.memory = block, memory
        self.encode = lambda text: self.special.encode(text, add_special_tokens=False).ids
        size = np.zeros(self.special.get_vocab_size(), np.int64)
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary
            for token, rank in table.items():
                size[rank] = len(token)
        else:
            for token, rank in self.special.get_vocab().items():
                size[rank] = len(token)  # byte-level: a character for each byte
        self.size = size
        rng = np.random.default_rng(7)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(block, x, np.uint64)), dtype=np.uint64) for x in (base, inverse))
        self.numbers = np.arange(block, dtype=np.int32)
        # What may follow a space that starts a part: not white space, nor a byte that starts a white-space character.
        self.starts = np.ones(256, bool)
        self.starts[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.keys = np.empty(0, np.uint64)
        #: By key: where its part's ids and bytes begin, and how many there are.
        self.first, self.count, self.begin, self.length = (np.empty(0, np.int64) for _ in range(4))
        self.pool, self.bytes = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def batch(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        held: list[bytes] = []
        room = self.block
        for text in texts:
            if len(text) >= self.block or END_OF_TEXT in text:
                yield from self._block(held)
                held, room = [], self.block
                import numpy as np

                whole = self.special.encode(text.decode(), add_special_tokens=False).ids if END_OF_TEXT in text else self.encode(text.decode())
                yield np.array(whole, "<u4").tobytes()
                continue
            if len(text) >= room:
                yield from self._block(held)
                held, room = [], self.block
            held.append(text)
            room -= len(text)
        yield from self._block(held)

    def _block(self, texts: list[bytes]) -> Iterator[bytes]:
        import numpy as np

        if not texts:
            return
        raw = b"".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        doc_starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            yield from (b"" for _ in texts)
            return
        opens = np.zeros(len(data), bool)
        opens[:-1] = (data[:-1] == 32) & self.starts[data[1:]]
        inner = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
        opens[inner - 1] = False  # a text's last byte is followed by nothing
        opens[doc_starts[doc_starts < len(data)]] = True
        at = np.flatnonzero(opens)
        ends = np.append(at[1:], len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.value[data] * self.powers[: len(data)], dtype=np.uint64)])
        keys = mixed((sums[ends] - sums[at]) * self.inverse[at] ^ (ends - at).astype(np.uint64))
        found, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, found)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == found[known]
        if not known.all():
            self._learn(raw, found[~known], at[index[~known]], ends[index[~known]])
            place = np.searchsorted(self.keys, found)
        number = place[inverse]
        first, count = self.first[number], self.count[number]
        place = np.repeat((self.begin[number] - at).astype(np.int32), ends - at)  # of the byte that a byte is compared with
        place += self.numbers[: len(data)]
        differ = np.flatnonzero(self.bytes.take(place, mode="clip") != data)
        wrong = np.union1d(np.searchsorted(at, differ, side="right") - 1, np.flatnonzero(self.length[number] != ends - at))
        pool = self.pool
        if len(wrong):  # another part has the same hash
            own = [np.array(self.encode(raw[a:b].decode()), np.uint32) for a, b in zip(at[wrong].tolist(), ends[wrong].tolist(), strict=True)]
            count[wrong] = [len(x) for x in own]
            first[wrong] = len(pool) + np.cumsum(count[wrong]) - count[wrong]
            pool = np.concatenate([pool, *own])
        done = np.cumsum(count)
        ids = pool[np.repeat(first - (done - count), count) + np.arange(done[-1])].astype("<u4")
        per_part = np.append(0, done)
        from_, to = per_part[np.searchsorted(at, doc_starts)], per_part[np.searchsorted(at, doc_starts + lengths)]
        whole = ids.tobytes()
        if len(self.keys) > self.memory or len(self.bytes) > 32 << 20:
            self.forget()
        for a, b in zip(from_.tolist(), to.tolist(), strict=True):
            yield whole[4 * a : 4 * b]

    def _learn(self, raw: bytes, keys, at, ends) -> None:
        import numpy as np

        spaced = np.frombuffer(raw, np.uint8)[at] == 32
        order = np.argsort(~spaced, kind="stable")  # parts that start with a space first
        keys, at, ends, together = keys[order], at[order], ends[order], int(spaced.sum())
        parts = [raw[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        ids = np.array(self.encode(b"".join(parts[:together]).decode()), np.uint32)
        reach = np.append(0, np.cumsum(self.size[ids]))
        bound = np.searchsorted(reach, np.append(0, np.cumsum([len(p) for p in parts[:together]])))
        assert not together or reach[-1] == sum(map(len, parts[:together]))
        others = [np.array(self.encode(part.decode()), np.uint32) for part in parts[together:]]
        sizes = np.array([len(x) for x in others], np.int64)
        length = ends - at
        columns = {
            "first": np.concatenate([bound[:-1], len(ids) + np.cumsum(sizes) - sizes]) + len(self.pool),
            "count": np.concatenate([np.diff(bound), sizes]),
            "begin": np.cumsum(length) - length + len(self.bytes),
            "length": length,
        }
        self.pool = np.concatenate([self.pool, ids, *others])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(parts), np.uint8)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        for name, values in columns.items():
            setattr(self, name, np.concatenate([getattr(self, name), values])[order])


def tokenized(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str | None, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for."""
    if paths is None:
        paths = public_paths()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        coder, end = ByteBpe(*paths), struct.pack("<I", end_id)
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.batch(texts), strict=True):
                ids += end
                n = len(ids) // 4
                start, piece = 0, 0
                length = n % capacity or min(n, capacity)
                while start < n:
                    raw = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(raw), raw if with_ids else None), strict=True):
                        column.append(value)
                    start, piece, length = start + length, piece + 1, capacity
                    held += len(raw) if with_ids else 40
                if held > 4 << 20:
                    yield batch_of(out)
                    out, held = [[], [], [], [], [], []], 0
        if out[0]:
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns if with_ids else columns[:5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def public_paths() -> tuple[str, str | None, str | None]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list, list, list]:
    """Best fit within one range: pieces as runs (size, first rank, count) in descending order of size take the smallest gaps
    that hold them, gaps as runs (size, first sequence, count) in ascending order; equal ones meet by rank, a run at a time.

    Returns the pieces left, the gaps left, and placements (size, first rank, count, first sequence, offset).
    """
    held: dict[int, list[tuple[int, int]]] = {}
    for size, first, count in sorted(gaps):
        held.setdefault(size, []).append((first, count))
    order = sorted(held)
    left, placed = [], []
    for size, rank, count in sorted(pieces, reverse=True):
        while count:
            at = bisect_left(order, size)
            if at == len(order):
                left.append((size, rank, count))
                break
            gap = order[at]
            first, room = held[gap].pop()
            n = min(count, room)
            placed.append((size, rank, n, first, capacity - gap))
            if room > n:
                held[gap].append((first + n, room - n))
            elif not held[gap]:
                del held[gap]
                del order[at]
            if gap > size:
                if gap - size not in held:
                    held[gap - size] = []
                    insort(order, gap - size)
                held[gap - size].append((first, n))
            rank, count = rank + n, count - n
    return left, [(gap, first, count) for gap, runs in held.items() for first, count in runs], placed


STATE = "kind int, size long, first long, count long, sequence long, offset long"
PIECE, GAP, PLACED = range(3)


def best_fit_rounds(runs: DataFrame, capacity: int, ranges: int = 8) -> tuple[list[DataFrame], int]:
    """Place all pieces. runs (size below the capacity, count) -> frames with STATE rows, placements among them, and the number of sequences.

    A round deals pieces and gaps out by ranges of size, a gap to the range of its successor, the largest unplaced piece that
    fits it; each range is swept by a task of its own. The driver sees sums over ranges only.
    """
    spark = runs.sparkSession
    state = materialize(runs.select(F.lit(PIECE).alias("kind"), "size", F.lit(0).cast("long").alias("first"), "count", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("offset")))
    cuts = state.selectExpr(f"percentile_approx(size, array({', '.join(str(k / ranges) for k in range(1, ranges))}), 10000) AS cuts").first()["cuts"] or []
    cuts = sorted(set(cuts))
    frames, sequences = [], 0
    own = sum((F.when(F.col("size") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    while True:
        now = state.filter(F.col("kind") != PLACED)
        told = now.groupBy("kind", F.when(F.col("kind") == PIECE, own).otherwise(-1).alias("range")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum("count").alias("count"), F.sum(F.col("size") * F.col("count")).alias("total"), F.sum(F.when(2 * F.col("size") > capacity, F.col("count")).otherwise(0)).alias("big")).collect()  # a row for each range
        pieces = sorted((r for r in told if r["kind"] == PIECE), key=lambda r: -r["range"])
        if not pieces:
            return frames, sequences
        widest = max((r["most"] for r in told if r["kind"] == GAP), default=0)
        opening: dict[int, tuple[int, int]] = {}  # range -> sequences to open for its largest pieces, the first one's number
        if widest < pieces[-1]["least"]:
            # Nothing fits any more. Pieces over half the capacity need a sequence each; the others at least their sum's worth.
            wanted = sum(r["big"] for r in pieces) or -(-sum(r["total"] for r in pieces) // capacity)
            for r in pieces:
                n = min(wanted, r["count"])
                if n:
                    opening[r["range"]] = (n, sequences)
                wanted, sequences = wanted - n, sequences + n
        successor = F.lit(-1)  # gaps that hold no piece are closed
        for r in reversed(pieces):
            successor = F.when(F.col("size") >= r["least"], r["range"]).otherwise(successor)
        placed = now.withColumn("range", F.when(F.col("kind") == PIECE, own).otherwise(successor)).filter("range >= 0")

        def swept(batches: Iterator[pa.RecordBatch], opening=opening) -> Iterator[pa.RecordBatch]:
            by_range: dict[int, tuple[list, list]] = {}
            for batch in batches:
                for range_, kind, *run in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    by_range.setdefault(range_, ([], []))[kind].append(tuple(run))
            out = []
            for range_, (pieces, gaps) in by_range.items():
                wanted, sequence = opening.get(range_, (0, 0))
                if wanted:
                    left = []
                    for size, rank, count in sorted(pieces, reverse=True):
                        n = min(wanted, count)
                        if n:
                            out.append((PLACED, size, rank, n, sequence, 0))
                            out.append((GAP, capacity - size, sequence, n, None, None))
                        if count > n:
                            left.append((size, rank + n, count - n))
                        wanted, sequence = wanted - n, sequence + n
                    out += [(PIECE, *run, None, None) for run in left] + [(GAP, *run, None, None) for run in gaps]
                    continue
                left, gaps, placed = sweep(pieces, gaps, capacity)
                out += [(PIECE, *run, None, None) for run in left] + [(GAP, *run, None, None) for run in gaps] + [(PLACED, *run) for run in placed]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *[pa.int64()] * 5], strict=True)], [f.split()[0] for f in STATE.split(", ")])

        dealt = placed.select("range", "kind", "size", "first", "count").repartitionByRange(ranges, "range").sortWithinPartitions("range", "kind", "size", "first")
        state = materialize(dealt.mapInArrow(swept, STATE))
        frames.append(state)


def pack(pieces: DataFrame, capacity: int = 1024, broadcast_rows: int = 200_000) -> DataFrame:
    """pieces (from :func:`tokenized`, read several times) with sequence_id and offset."""
    spark = pieces.sparkSession
    numbered = pieces.withColumns({"one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()})
    ranked = range_prefix(numbered, ["length", "doc_id", "piece", "start", "ids_crc32", "row"], {"rank": "one"})
    runs = materialize(pieces.groupBy(F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("count")))  # a row for each size up to the capacity
    counts = sorted(map(tuple, runs.collect()))
    frames, sequences = best_fit_rounds(runs.filter(F.col("size") < capacity), capacity)
    before, at = {}, 0
    for size, count in counts:
        before[size], at = at, at + count
    # Ranks go on from size to size.
    starts = spark.createDataFrame(list(before.items()), "size long, before long")
    full = spark.createDataFrame([(PLACED, capacity, 0, n, sequences, 0) for size, n in counts if size == capacity], STATE)
    every = full
    for frame in frames:
        every = every.unionByName(frame.filter(F.col("kind") == PLACED))
    places = materialize(every.join(F.broadcast(starts), "size").select("size", (F.col("first") + F.col("before")).alias("from"), (F.col("first") + F.col("before") + F.col("count")).alias("to"), "sequence", "offset").coalesce(1))
    drop_materialized(runs, *frames)
    # Rows of places are bounded by the capacity and the rounds and not by the pieces; beyond the limit they are joined by size.
    side = F.broadcast(places) if places.count() <= broadcast_rows else places.hint("merge")
    rank = F.col("rank") - 1
    found = ranked.join(side, (F.col("length") == F.col("size")) & (rank >= F.col("from")) & (rank < F.col("to")))
    return found.select(*pieces.columns, (F.col("sequence") + rank - F.col("from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    return pack(materialize(tokenized(docs, capacity, end_id, paths)), capacity)
