"""Near duplicates among embeddings by a robust-pruned flat graph.

1. Equal vectors form a class; the smallest vec_id stands for it, with the number of its members (a grouped aggregate).
2. Centres are fitted by spherical k-means on a bounded sample (``fit_rows`` classes, by a hash of vec_id). Every class goes
   to the shards of its ``overlap`` nearest centres. A shard of more than ``split_rows`` rows gets centres of its own, fitted
   on a bounded sample of its rows in a task, and its classes go to the nearest two, and so on. Cells between which half of
   the sample's pairs link stay together: they are a dense ball that centres would divide at random. A shard of more than
   ``shard_rows`` is dealt into parts, and each pair of parts becomes a shard, so that no task holds more than twice that.
3. In a shard each vector's candidates, its nearest neighbours and some at growing ranks, are pruned robustly: a candidate is
   dropped if a kept neighbour is closer to it, by the factor ``alpha``, than the vector itself. The adjacency lists of a
   vector's shards are united (one grouped aggregate) into one flat graph.
4. The graph is searched: a shard holds its vectors and, as a rim, the vectors outside that the united lists of vectors at
   home in it lead to within range (a vector is at home in the first of its shards). For each of its vectors there is a
   greedy search from the shard's medoid along the lists, both ways, then range expansion through every vector found within
   the threshold until no new one turns up.
5. Pairs found are verified by cosine in double precision. Those that share a shard are counted in the first that both share;
   others, found over the rim, where a vector is at home. A shard returns counts and, for components, one link to the
   smallest member of each group, not all pairs.
6. Recall is audited twice. In a shard, the links of a few vectors are compared with products of rows; where one is missing,
   or where they outnumber the lists (as in dense balls), the shard's pairs are taken from such products. Over the whole table,
   the links of a sample are compared with brute force over all vectors. The sample grows from ``audit_rows`` vectors until
   ``audit_links`` of its vectors have links. Where its recall, over links and as the mean of its linked vectors, is below
   ``least_recall``, everything is done again with two more shards for each vector.
7. Where nine shards do not reach it either, or ``audit_most`` vectors hold too few links for a verdict, all vectors are
   compared, in pairs of blocks: exact, at a cost that grows with the square of their number.

Only links with cosine >= ``threshold`` are returned. Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, and vectors of different lengths don't link; rows that share a vec_id, or have
none, are vectors of their own (a component's id is the smallest vec_id of its rows, null if none has one); equal vectors
link; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import drop_materialized, materialize, shuffle_partitions
from quillspark.llm.components import components
from quillspark.llm.suffix_dedup import numbered

def unit_vectors(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) -> (vec_id, v): packed doubles of length 1, null where a vector can't link."""

    def unit(x: list | None) -> bytes | None:
        if not x or any(c is None for c in x):
            return None
        x = np.array(x, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top
        return (x / np.sqrt(x @ x)).tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unit(x.as_py()) for x in batch.column(1)], pa.binary())], ["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(packed, "vec_id long, v binary")


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.where(norms > 1e-12, norms, 1), centres)
    return centres


def joined_cells(x: np.ndarray, centres: np.ndarray, threshold: float, most: int = 8000) -> np.ndarray:
    """For each centre the smallest of its group: cells of which half of the pairs of vectors between them link are one dense
    ball that the centres divide at random, and stay together. x: a sample, of which ``most`` rows are looked at."""
    x = x[:most]
    own = np.argmax(x @ centres.T, 1)
    sizes = np.bincount(own, minlength=len(centres))
    links = np.zeros((len(centres), len(centres)), np.int64)
    for a in range(0, len(x), 1000):
        i, j = np.nonzero(x[a : a + 1000] @ x.T >= threshold)
        np.add.at(links, (own[i + a], own[j]), 1)
    pairs = sizes[:, None] * sizes[None, :]
    left, right = np.nonzero((2 * links >= pairs) & (pairs >= 16))
    return _labels(len(centres), left, right)


def robust_prune(near: np.ndarray, sims: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> list[int]:
    """The neighbours kept for one vector. near: candidates in descending order of sims, their cosines with it."""
    kept: list[int] = []
    alive = np.ones(len(near), bool)
    between = x[near] @ x[near].T
    for k in range(len(near)):
        if alive[k]:
            kept.append(int(near[k]))
            if len(kept) == degree:
                break
            # Distances of unit vectors: squared 2 - 2 * cosine.
            alive &= alpha * (1 - between[k]) > 1 - sims
    return kept


class Shard:
    """Vectors of one shard with their adjacency lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, members: np.ndarray | None = None):
        """members: the local numbers that are searched for; the others are the rim."""
        self.ids, self.x = ids, x
        self.members = np.arange(len(ids)) if members is None else members
        inner = x[self.members]
        self.medoid = int(self.members[np.argmax(inner @ inner.mean(0))])

    def neighbours(self, candidates: int, degree: int, alpha: float) -> list[list[int]]:
        """Pruned lists of local numbers: of the nearest, and half as many of candidates at growing ranks beyond them."""
        n, lists = len(self.x), []
        take, far = min(candidates, n - 1), []
        rank = float(take)
        while int(rank) < n - 1 and take > 0:
            far.append(int(rank))
            rank = max(rank + 1, rank * 1.15)
        for a in range(0, n, 512):
            sims = self.x[a : a + 512] @ self.x.T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
            if take <= 0:
                lists += [[] for _ in sims]
                continue
            ranked = np.argpartition(-sims, [take - 1, *far], 1)
            near, beyond = ranked[:, :take], ranked[:, far]
            for k in range(len(sims)):
                s = sims[k, near[k]]
                order = np.lexsort((near[k], -s))
                own = robust_prune(near[k][order], s[order], self.x, degree, alpha)
                if far:
                    own += robust_prune(beyond[k], sims[k, beyond[k]], self.x, degree // 2, alpha)
                lists.append(own)
        return lists

    def search(self, lists: list[np.ndarray], reach: float, width: int = 24) -> Iterator[np.ndarray]:
        """For each member, the local numbers found with a cosine of at least ``reach``: greedy search from the medoid, then range expansion."""
        seen = np.full(len(self.x), -1, np.int64)
        for q in self.members.tolist():
            v = self.x[q]
            seen[self.medoid] = q
            pool = [(float(self.x[self.medoid] @ v), self.medoid)]
            open_ = list(pool)
            hits = [self.medoid] if pool[0][0] >= reach else []
            while open_:
                best = max(open_)
                open_.remove(best)
                if len(pool) >= width and best[0] < pool[-1][0]:
                    break
                following = lists[best[1]]
                following = following[seen[following] != q]
                if not len(following):
                    continue
                seen[following] = q
                sims = self.x[following] @ v
                near = list(zip(sims.tolist(), following.tolist(), strict=True))
                hits += [m for s, m in near if s >= reach]
                pool = sorted(pool + near, reverse=True)[:width]
                floor = pool[-1][0] if len(pool) == width else -2.0
                open_ = [p for p in open_ + near if p[0] >= floor]
                if hits and q in hits and best[0] >= reach:
                    break  # arrived; the expansion does the rest
            # Expansion: what is in range is followed, from the vector itself too.
            found = np.unique(np.array([q, *hits], np.int64))
            seen[found] = q + len(self.x)
            front = found
            while len(front):
                following = np.unique(np.concatenate([lists[m] for m in front.tolist()]))
                following = following[seen[following] != q + len(self.x)]
                if not len(following):
                    break
                seen[following] = q + len(self.x)
                front = following[self.x[following] @ v >= reach]
                found = np.concatenate([found, front])
            yield found[found != q]

    def sample_links(self, threshold: float, rows: int = 32) -> dict[int, np.ndarray]:
        """The links of some members, spread over all, by products of rows."""
        some = self.members[np.unique(np.linspace(0, len(self.members) - 1, min(rows, len(self.members))).astype(np.int64))]
        near = self.x[some] @ self.x.T >= threshold + 1e-9
        near[np.arange(len(some)), some] = False
        return {q: np.flatnonzero(row) for q, row in zip(some.tolist(), near, strict=True)}

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of local numbers (smaller, larger) with a cosine of at least ``threshold``, by products of blocks of rows."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(self.x), 512):
            sims = self.x[a : a + 512] @ self.x[a:].T
            i, j = np.nonzero(sims >= threshold - 1e-9)
            i, j = i[j > i], j[j > i]
            real = sims[i, j] >= threshold + 1e-9
            close = np.flatnonzero(~real)  # the order of a product's sums may tell
            real[close] = np.einsum("ij,ij->i", self.x[i[close] + a], self.x[j[close] + a]) >= threshold
            left.append(i[real] + a)
            right.append(j[real] + a)
        return np.concatenate(left), np.concatenate(right)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of one shard after another; the first column is the shard."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        a = 0
        for b in range(1, len(names) + 1):
            if b == len(names) or names[b] != names[a]:
                if held and names[a] != now:
                    yield held
                    held = []
                now = names[a]
                held.append(batch.slice(a, b - a))
                a = b
    if held:
        yield held


def _load(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    held = pa.Table.from_batches(parts)
    ids = np.array(held.column("rep").to_pylist(), np.int64)
    order = np.argsort(ids, kind="stable")
    held = held.take(pa.array(order))
    raw = held.column("v").to_pylist()
    return ids[order], np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1), held


def _nearest(raw: list[bytes], centres: dict[int, np.ndarray], take: int) -> list[list[int]]:
    """For each packed vector the numbers of its nearest centres among those of its length."""
    out: list[list[int]] = [[0]] * len(raw)
    for w in {len(v) for v in raw} & centres.keys():
        rows = [n for n, v in enumerate(raw) if len(v) == w]
        sims = np.frombuffer(b"".join(raw[n] for n in rows), np.float64).reshape(len(rows), -1) @ centres[w].T
        k = min(take, sims.shape[1])
        for n, own in zip(rows, np.argpartition(-sims, k - 1, 1)[:, :k].tolist(), strict=True):
            out[n] = sorted(own)
    return out


def _split(cells: DataFrame, sizes: DataFrame, split_rows: int, shard_rows: int, threshold: float, most: int = 256) -> DataFrame:
    """cells (cell, rep, weight, v) of which those of more than split_rows rows (sizes: cell, n) are divided among centres of their own."""
    big = sizes.filter(F.col("n") > split_rows).withColumn("k", F.least(F.lit(most), F.ceil(4 * F.col("n") / shard_rows)).cast("int"))
    held = cells.join(big, "cell")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            table = pa.Table.from_batches(rows)
            x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, -1)
            centres = fit_centres(x, table.column("k")[0].as_py())
            groups = joined_cells(x, centres, threshold).tolist()
            yield pa.RecordBatch.from_arrays([table.column("cell").slice(0, 1).combine_chunks(), pa.array([centres.tobytes()], pa.binary()), pa.array([groups], pa.list_(pa.int64()))], ["cell", "centres", "groups"])

    # About 8 rows for each centre, by a hash of vec_id.
    sample = held.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.greatest(F.lit(1), F.floor(F.col("n") / (8 * F.col("k"))).cast("long"))) == 0)
    centres = materialize(sample.select("cell", "v", "k", F.xxhash64("rep").alias("h")).repartition("cell").sortWithinPartitions("cell", "h").mapInArrow(fit, "cell string, centres binary, groups array<long>"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells_, reps, weights, vectors, packed, groups = (batch.column(k).to_pylist() for k in range(6))
            out, at = [], {}
            for n, cell in enumerate(cells_):
                at.setdefault(cell, []).append(n)
            for cell, rows in at.items():
                w = len(vectors[rows[0]])
                near = _nearest([vectors[n] for n in rows], {w: np.frombuffer(packed[rows[0]], np.float64).reshape(-1, w // 8)}, 2)
                out += [(f"{cell}.{c}", reps[n], weights[n], vectors[n]) for n, own in zip(rows, near, strict=True) for c in sorted({groups[rows[0]][c] for c in own})]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["cell", "rep", "weight", "v"])

    parts = cells.join(centres, "cell").select("cell", "rep", "weight", "v", "centres", "groups").mapInArrow(assign, "cell string, rep long, weight long, v binary")
    return materialize(cells.join(centres.select("cell"), "cell", "left_anti").unionByName(parts))


def _shards(classes: DataFrame, overlap: int, shard_rows: int, fit_rows: int, split_rows: int, threshold: float, levels: int = 4) -> DataFrame:
    """(shard, shards, rep, weight, v): each class in each of its shards."""
    spark = classes.sparkSession
    total = classes.count()
    k = -(-2 * total * overlap // max(1, shard_rows)) if total > shard_rows else 1  # shards of half that size on average
    sample = classes.orderBy(F.xxhash64("rep")).limit(min(total, fit_rows)).select("v").toPandas()["v"] if k > 1 else []
    widths = {len(v) for v in sample}
    samples = {w: np.frombuffer(b"".join(v for v in sample if len(v) == w), np.float64).reshape(-1, w // 8) for w in widths}
    centres = {w: fit_centres(x, min(k, fit_rows // 8)) for w, x in samples.items()}
    groups = {w: joined_cells(x, centres[w], threshold).tolist() for w, x in samples.items()}
    shared = spark.sparkContext.broadcast((centres, groups))  # at most fit_rows / 8 centres; larger shards get centres of their own

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            centres, groups = shared.value
            names = [[f"{len(v)}-{c}" for c in sorted({groups[len(v)][c] if len(v) in groups else c for c in own})] for v, own in zip(raw, _nearest(raw, centres, overlap), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), *batch.columns], ["cells", "rep", "weight", "v"])

    cells = materialize(classes.select("rep", "weight", "v").mapInArrow(assign, "cells array<string>, rep long, weight long, v binary").select(F.explode("cells").alias("cell"), "rep", "weight", "v"))
    largest = None
    for _ in range(levels):
        sizes = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        now = sizes.agg(F.max("n")).first()[0] or 0
        if now <= split_rows or now == largest:
            break
        cells, before, largest = _split(cells, sizes, split_rows, shard_rows, threshold), cells, now
        drop_materialized(before)
    # What is still above the size, as a dense ball that no centres divide, is dealt into pairs of parts.
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = cells.select("rep", "cell").join(sizes, "cell").select("rep", "cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    shards = dealt.select("rep", F.concat_ws("/", "cell", F.least("part", "other"), F.greatest("part", "other")).alias("shard")).groupBy("rep").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    return classes.join(shards, "rep").select(F.explode("shards").alias("shard"), "shards", "rep", "weight", "v")


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest in its group of those that pairs connect."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _find(classes: DataFrame, threshold: float, overlap: int, shard_rows: int, fit_rows: int, split_rows: int, candidates: int, degree: int, alpha: float) -> DataFrame:
    """(rep, n_links, other): for each class and shard the links counted there (members), and the smallest member of its group."""
    parts, reach = 2 * shuffle_partitions(classes.sparkSession), threshold - 0.04
    sharded = materialize(_shards(classes, overlap, shard_rows, fit_rows, split_rows, threshold).repartition(parts, "shard").sortWithinPartitions("shard"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_shard(batches):
            ids, x, _ = _load(held)
            near = Shard(ids, x).neighbours(candidates, degree, alpha)
            within = [[bool(x[k] @ x[m] >= reach) for m in own] for k, own in enumerate(near)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[m].tolist() for m in near], pa.list_(pa.int64())), pa.array(within, pa.list_(pa.bool_()))], ["rep", "near", "within"])

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "shard").sortWithinPartitions("shard")

    lists = grouped(sharded.select("shard", "rep", "v")).mapInArrow(build, "rep long, near array<long>, within array<boolean>")
    edges = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("near", "within"))))  # at most 1.5 * ``degree`` for each shard of a vector
    united = materialize(lists.groupBy("rep").agg(edges.alias("edges")).select("rep", F.transform("edges", lambda e: e["near"]).alias("near"), F.transform(F.filter("edges", lambda e: e["within"]), lambda e: e["near"]).alias("within")))
    inner = sharded.join(united.select("rep", "near"), "rep").select("shard", "shards", "rep", "weight", "v", "near", F.lit(False).alias("rim"))
    # The rim: edges of range from vectors at home in a shard to vectors outside of it.
    homes = sharded.select("rep", "shards", "weight", "v", F.element_at("shards", 1).alias("home")).filter(F.col("shard") == F.col("home")).drop("home")
    leads = homes.select("rep", F.element_at("shards", 1).alias("home")).join(united.select("rep", F.explode("within").alias("to")), "rep").select("home", "to").distinct()
    rim = homes.join(leads, F.col("rep") == F.col("to")).filter(~F.array_contains("shards", F.col("home"))).select(F.col("home").alias("shard"), "shards", "rep", "weight", "v", F.array().cast("array<long>").alias("near"), F.lit(True).alias("rim"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_shard(batches):
            ids, x, rows = _load(held)
            n = len(ids)
            name, weight, shards = rows.column("shard")[0].as_py(), np.array(rows.column("weight").to_pylist(), np.int64), rows.column("shards").to_pylist()
            outside = np.array(rows.column("rim").to_pylist(), bool)
            left, right = [], []
            for k, near in enumerate(rows.column("near").to_pylist()):
                near = np.array(near, np.int64)
                at = np.searchsorted(ids, near)
                at = at[(at < n) & (ids[np.minimum(at, n - 1)] == near)] if len(near) else at
                left.append(np.full(len(at), k))
                right.append(at)
            left, right = np.concatenate(left), np.concatenate(right)
            edges = np.unique(np.concatenate([left * n + right, right * n + left]))
            bounds = np.searchsorted(edges, np.arange(n + 1) * n)
            lists = [edges[bounds[k] : bounds[k + 1]] - k * n for k in range(n)]
            shard = Shard(ids, x, np.flatnonzero(~outside))
            known = shard.sample_links(threshold)
            # Where links outnumber a vector's list, as in a dense ball, a search would have to pass through all of them.
            searched = np.mean([len(f) for f in known.values()]) <= degree
            found = dict(zip(shard.members.tolist(), shard.search(lists, reach), strict=True)) if searched else {}
            if searched and all(np.isin(links, found[q]).all() for q, links in known.items()):
                left = np.repeat(shard.members, [len(f) for f in found.values()])
                right = np.concatenate(list(found.values()))
                pairs = np.unique(np.minimum(left, right) * n + np.maximum(left, right))
                left, right = pairs // n, pairs % n
                real = np.einsum("ij,ij->i", x[left], x[right]) >= threshold
                left, right = left[real], right[real]
            else:  # the audit missed links, or there are more than lists hold
                left, right = shard.pairs(threshold)
                inside = ~(outside[left] & outside[right])
                left, right = left[inside], right[inside]
            label = _labels(n, left, right)
            # Counted where the two meet first, and where a vector is at home if they meet nowhere, so that no pair counts twice.
            numbers = {s: k for k, s in enumerate(sorted({s for own in shards for s in own}))}
            held = np.full((n, max(map(len, shards))), len(numbers))
            for k, own in enumerate(shards):
                held[k, : len(own)] = [numbers[s] for s in own]
            home, here = held[:, 0] == numbers[name], numbers[name]
            count = np.zeros(n, np.int64)
            step = max(1, 4_000_000 // held.shape[1] ** 2)
            for a in range(0, len(left), step):
                i, j = left[a : a + step], right[a : a + step]
                both = (held[i][:, :, None] == held[j][:, None, :]) & (held[i] < len(numbers))[:, :, None]
                meet = np.where(both, held[i][:, :, None], len(numbers)).min((1, 2))  # the first shard that both share
                for p, q in ((i, j), (j, i)):
                    counts = (meet == here) | (meet == len(numbers)) & home[p]
                    count += np.bincount(p[counts], weight[q[counts]], n).astype(np.int64)
            linked = np.flatnonzero((count > 0) | (label != np.arange(n)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(count[linked]), pa.array(ids[label[linked]])], ["rep", "n_links", "other"])

    return grouped(inner.unionByName(rim)).mapInArrow(search, "rep long, n_links long, other long")


def _find_all(classes: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """What :func:`_find` returns, from comparing all classes: each pair of blocks of about ``block_rows`` classes is a shard."""
    blocks = max(1, -(-classes.count() // block_rows))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    dealt = classes.select("rep", "weight", "v", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Vectors of different lengths don't link and are not compared.
    shard = F.concat_ws("/", F.length("v"), F.least("block", "other"), F.greatest("block", "other"))
    sharded = dealt.select(shard.alias("shard"), "rep", "weight", "v", "block").repartition(2 * shuffle_partitions(classes.sparkSession), "shard").sortWithinPartitions("shard")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_shard(batches):
            ids, x, rows = _load(held)
            weight, own = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("weight", "block"))
            left, right = Shard(ids, x).pairs(threshold)
            _, one, two = rows.column("shard")[0].as_py().split("/")
            if one != two:  # pairs within a block belong to the shard of that block alone
                across = own[left] != own[right]
                left, right = left[across], right[across]
            count = np.bincount(left, weight[right], len(ids)) + np.bincount(right, weight[left], len(ids))
            label, linked = _labels(len(ids), left, right), np.flatnonzero(count > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(count[linked].astype(np.int64)), pa.array(ids[label[linked]])], ["rep", "n_links", "other"])

    return sharded.mapInArrow(compare, "rep long, n_links long, other long")


def audit(classes: DataFrame, found: DataFrame, threshold: float, audit_rows: int = 256, audit_links: int = 200, audit_most: int = 16_384) -> float | None:
    """The share that was found of the links of a sample of classes, picked by a hash of vec_id: over all its links or as
    the mean of its linked classes, whichever is less. The sample starts with ``audit_rows`` classes and grows until
    ``audit_links`` of them have links. None: ``audit_most`` classes hold fewer, and there are more classes than that.
    """
    spark = classes.sparkSession
    total, size = classes.count(), audit_rows
    counted = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    while True:
        sample = classes.orderBy(F.xxhash64("rep", F.lit(1))).limit(size).select("rep", "v").toPandas()  # at most audit_most
        shared = spark.sparkContext.broadcast((sample["rep"].to_numpy(np.int64), sample["v"].tolist()))

        def brute(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            count = np.zeros(len(ids), np.int64)
            by_width: dict[int, list] = {}
            for n, v in enumerate(vectors):
                by_width.setdefault(len(v), []).append(n)
            blocks = [(w, np.array(own[a : a + 512])) for w, own in by_width.items() for a in range(0, len(own), 512)]
            blocks = [(w, own, np.frombuffer(b"".join(vectors[n] for n in own), np.float64).reshape(len(own), -1)) for w, own in blocks]
            for batch in batches:
                raw, reps, weights = batch.column(2).to_pylist(), np.array(batch.column(0).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), np.int64)
                for width in by_width.keys() & {len(v) for v in raw}:
                    rows = [n for n, v in enumerate(raw) if len(v) == width]
                    x = np.frombuffer(b"".join(raw[n] for n in rows), np.float64).reshape(len(rows), -1)
                    for w, own, y in blocks:
                        if w == width:
                            near = (y @ x.T >= threshold) & (ids[own][:, None] != reps[rows][None, :])
                            count[own] += near @ weights[rows]
            linked = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(count[linked])], ["rep", "links"])

        truth = classes.select("rep", "weight", "v").mapInArrow(brute, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
        got = F.least("links", F.coalesce("n_links", F.lit(0)))
        linked, links, held, mean = truth.join(counted, "rep", "left").agg(F.count(F.lit(1)), F.sum("links"), F.sum(got), F.avg(got / F.col("links"))).first()
        shared.unpersist()
        if linked >= audit_links or size >= total:
            return min(held / links, mean) if linked else 1.0
        if size >= audit_most:
            return None
        size = min(8 * size, audit_most)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, overlap: int = 3, shard_rows: int = 1000, fit_rows: int = 20_000, split_rows: int = 8000, candidates: int = 48, degree: int = 16, alpha: float = 1.2, audit_rows: int = 256, least_recall: float = 0.97, audit_links: int = 200, audit_most: int = 16_384) -> DataFrame:
    """rows (vec_id, embedding) -> a row each: vec_id, n_links, component_id."""
    packed = materialize(unit_vectors(rows))
    vectors = numbered(packed.withColumn("text", F.hex("v")), "id", doc_id="vec_id", repeats_are_one=False).drop("text")
    classes = vectors.filter("v is not null").groupBy("v").agg(F.min(F.struct("id", "vec_id")).alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.select(F.col("first.id").alias("rep"), F.col("first.vec_id").alias("name"), "weight", "v"))
    while True:
        found = materialize(_find(classes.drop("name"), threshold, overlap, shard_rows, fit_rows, split_rows, candidates, degree, alpha))
        recall = audit(classes, found, threshold, audit_rows, audit_links, audit_most)
        if recall is not None and recall >= least_recall:
            break
        drop_materialized(found)
        if recall is None or overlap >= 9:
            found = materialize(_find_all(classes, threshold, 2 * shard_rows))
            break
        overlap += 2
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    roots = classes.select(F.col("rep").alias("root"), F.col("name").alias("component_id"))
    by_class = classes.join(links, "rep", "left").join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(roots, "root")
    by_class = by_class.select("v", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    every = vectors.select("vec_id", "v").join(by_class, "v", "left")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
