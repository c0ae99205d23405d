"""Embeddings, chat, the pipeline and the queries' registration."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, embed_graph, queries

FOLDER = "/root/testdata/sf0.001"


def brute(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        least = np.array([min([label[k], *label[near[k]]]) for k in range(len(x))])
        if (least == label).all():
            break
        label = least
    return {i: (int(near[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("shard_rows", [1000, 40])
def test_embeddings(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(n, 16)) * s for c, n, s in zip(centres, [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 80, 9], np.linspace(0.05, 0.4, 12), strict=True)])
    x = np.concatenate([x, x[:5], x[:3]])
    ids = list(range(100, 100 + len(x)))
    rows = [(i, [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [None] * 16, 0), (6, [1.0, 0.0], 0), (7, [float("inf")] + [0.0] * 15, 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_graph.near_duplicates(frame, shard_rows=shard_rows).collect()}
    want = brute(ids, x)
    assert {i: got[i] for i, *_ in odd} == {i: (0, i) for i, *_ in odd}
    assert sum(got[i][0] for i in ids) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.97 * len(ids)


def clumps(seed=7, groups=5, size=60, width=64):
    """Groups of more different vectors than a vector's list has candidates, all linked with each other."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=width)
    centres = [base + 0.25 * rng.normal(size=width) for _ in range(groups)]
    return np.concatenate([c + 0.01 * rng.normal(size=(size, width)) for c in centres])


def test_embeddings_dense_groups(spark):
    x = clumps()
    ids = list(range(len(x)))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_graph.near_duplicates(frame).collect()}
    assert got == brute(ids, x) and min(n for n, _ in got.values()) > 48


def as_classes(spark, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, 1, r.tobytes()) for i, r in enumerate(x)], "rep long, weight long, v binary")


def test_embeddings_audit(spark):
    rng = np.random.default_rng(8)
    few = rng.normal(size=(4000, 64))
    few = np.concatenate([few, few[:1] + 0.01 * rng.normal(size=(1, 64))])
    none = spark.createDataFrame([], "rep long, n_links long, other long")
    # Two linked vectors among 4001: a sample of 256 holds neither.
    assert embed_graph.audit(as_classes(spark, few), none, 0.9, 256) == 0
    assert embed_graph.audit(as_classes(spark, few), none, 0.9, 256, audit_most=256) is None
    # One group's links are all found and outweigh the pairs', of which none is.
    x = rng.normal(size=(41, 64))
    x = np.concatenate([x[0] + 0.01 * rng.normal(size=(100, 64)), x[1:], x[1:] + 0.01 * rng.normal(size=(40, 64))])
    found = spark.createDataFrame([(i, 99, 0) for i in range(100)], none.schema)
    assert embed_graph.audit(as_classes(spark, x), found, 0.9, 256) == pytest.approx(100 / 180)


def test_embeddings_without_a_verdict(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 64))
    x = np.concatenate([x, x + 0.4 * rng.normal(size=(150, 64))])  # pairs at a cosine of about 0.93
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_graph.near_duplicates(frame, overlap=1, shard_rows=10, audit_rows=4, audit_most=4).collect()}
    assert got == brute(list(range(len(x))), x) and sum(n for n, _ in got.values()) > 200


def test_embeddings_search_that_misses(spark, monkeypatch):
    """A pair that the search finds in one shard and misses in another counts once."""
    whole = embed_graph.Shard.search

    def search(self, lists, reach, width=24):
        return (found if self.ids[0] % 2 else found[:0] for found in whole(self, lists, reach, width))

    monkeypatch.setattr(embed_graph.Shard, "search", search)
    rng = np.random.default_rng(12)
    x = np.concatenate([c + 0.02 * rng.normal(size=(4, 64)) for c in rng.normal(size=(30, 64))])
    classes = as_classes(spark, x)
    held = {}
    for r in embed_graph._shards(classes, 3, 30, 20_000, 240, 0.9).select("shard", "rep").collect():
        held.setdefault(r.rep, set()).add(r.shard)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    least = {a: sum(bool(near[a, b] and held[a] & held[b]) for b in held if a != b) for a in held}
    found = embed_graph._find(classes, 0.9, 3, 30, 20_000, 240, 48, 16, 1.2)
    got = {r.rep: r.n for r in found.groupBy("rep").agg({"n_links": "sum"}).withColumnRenamed("sum(n_links)", "n").collect()}
    assert all(least[a] <= got.get(a, 0) <= near[a].sum() - 1 for a in held) and sum(got.values()) >= sum(least.values()) > 0


def test_embeddings_dense_ball(spark):
    """A ball of more vectors than a shard holds, all linked, loses no link; vectors around one direction that don't link stay apart."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    ball = centre + 0.1 * rng.normal(size=(400, 64))
    cone = 3 * rng.normal(size=64) + rng.normal(size=(300, 64)) * 2
    x = np.concatenate([ball, cone, ball[:1]])
    ids = list(range(len(x)))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_graph.near_duplicates(frame, shard_rows=60, split_rows=120, fit_rows=400).collect()}
    want = brute(ids, x)
    assert got == want and want[0][0] == 400 and min(n for n, _ in want.values()) == 0
    unit = cone / np.linalg.norm(cone, axis=1, keepdims=True)
    centres = embed_graph.fit_centres(unit, 8)
    assert embed_graph.joined_cells(unit, centres, 0.9).tolist() == list(range(8))


def test_embeddings_levels_and_shared_ids(spark):
    """Shards that get centres of their own; rows that share a vec_id or have none are vectors of their own."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 32))
    x = np.concatenate([x, x[:250] + 0.2 * rng.normal(size=(250, 32)), x[:5]])
    ids = list(range(len(x)))
    frame = spark.createDataFrame([(i, r.tolist(), "s", 1, b"v") for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, shard string, rep long, v binary").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_graph.near_duplicates(frame, shard_rows=20, split_rows=40, fit_rows=64).collect()}
    want = brute(ids, x)
    assert sum(got[i][0] for i in ids) >= 0.97 * sum(n for n, _ in want.values()) > 400
    assert all(got[i][0] <= want[i][0] for i in ids) and sum(got[i][1] == want[i][1] for i in ids) >= 0.97 * len(ids)
    rows = [(5, x[0]), (5, x[1]), (None, x[1]), (None, x[2]), (3, x[0]), (None, None), (9, x[3]), (9, x[3])]
    shared = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embed_graph.near_duplicates(shared).select("vec_id", "n_links", "component_id").collect()), key=repr)
    assert got == sorted([(5, 1, 3), (5, 1, 5), (None, 1, 5), (None, 0, None), (3, 1, 3), (None, 0, None), (9, 1, 9), (9, 1, 9)], key=repr)


def test_embeddings_empty(spark):
    assert embed_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a|> b", ""]), st.text(alphabet="a<\\[/]s>INSTY|turn é\n", max_size=25) | st.sampled_from(["</s>[INST] ok [/INST]", "<\\s>", "\\", "<<SYS>>", "<</SYS>>\\"])), max_size=6))
def test_chat_round_trip(turns):
    text = "".join(chat.marks(role)[0] + chat.escape(said) + chat.marks(role)[1] for role, said in turns)
    assert list(chat.parse(text)) == turns


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", "<s>"), (1, 5, "user", "end"), (2, 0, "user", "only"), (None, 0, "assistant", ""), (3, None, "user", "x"), (3, 1, None, "y")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat.expand(frame)
    held = [(r.conv_id, r.example, r.text[r.loss_start : r.loss_end]) for r in examples.collect()]
    assert sorted(held, key=str) == sorted([(1, 0, "a1"), (1, 1, "<\\s>"), (1, 2, ""), (2, 0, ""), (None, 0, ""), (3, 0, "")], key=str)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert got[1].n_turns == 6 and got[1].loss_chars == 5 and got[1].loss_sha256 == hashlib.sha256(b"a1<s>").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\nu\nassistant\na1\nuser\n\nassistant\n<s>\nuser\nend\n").hexdigest()
    assert got[3].turns_sha256 == hashlib.sha256(b"\ny\nuser\nx\n").hexdigest()
    assert chat.read_back(chat.expand(frame.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    frame = queries.queries()[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


def plain_mix(rows, weights=(1, 2, 3), passes=3):
    """Weighted fair queueing by the book: (times taken by row, targets by source). rows: (doc_id, size, source)."""
    keys = sorted({r[2] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    size = {k: sum(r[1] for r in rows if r[2] == k) for k in keys}
    weight = {k: weights[n % len(weights)] for n, k in enumerate(keys)}
    budget, target, open_ = sum(size.values()), {}, set(keys)
    while open_:
        left = budget - sum(target.values())
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if level * weight[k] > passes * size[k]]
        if not over:
            target |= {k: level * weight[k] for k in open_}
            break
        for k in over:
            target[k] = passes * size[k]
        open_ -= set(over)
    queue = []
    for n, k in enumerate(keys):
        upto = 0
        own = [(hashlib.md5((str(r[0]) if r[0] is not None else "").encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1], at) for at, r in enumerate(rows) if r[2] == k]
        for *_, words, at in sorted(own):
            upto += words
            if words:
                queue += [((upto + e * size[k]) / target[k], n, upto + e * size[k], words, at) for e in range(passes)]
    taken, total = [0] * len(rows), 0
    for _, _, _, words, at in sorted(queue):
        if total + words > budget:
            break
        taken[at] += 1
        total += words
    return taken, target


def check_packed(got, texts, capacity=1024):
    """got: rows of packed pieces; texts: (doc_id, text), ids not repeated."""
    import zlib

    from tokenizers import Tokenizer

    from quillspark.llm import packing

    plain = Tokenizer.from_file(packing.public_paths()[0])
    by_doc, places = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in texts}
    total = 0
    for i, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // capacity)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.02 * -(-total // capacity) + 1


def test_pipeline(spark):
    """Each stage against a brute-force version, on what the stage before has left."""
    import corpus_pipeline
    from test_text_operators import WORD, brute_components, brute_repeats, plain_toxicity, shingles

    from quillspark.llm import toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        rows = [(r.doc_id, r.text, r.source) for r in before.select("doc_id", "text", "source").collect()]
        docs = stage(spark, docs, FOLDER).cache()
        got = docs.collect()
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "toxicity":
            lexicon = toxicity.learn(before, queries.labelled(spark, FOLDER, "toxic", 5, 0))
            assert sorted(r.doc_id for r in got) == sorted(i for i, t, _ in rows if plain_toxicity(lexicon, t) < 0.5)
            assert len(got) < len(rows)
        if name == "ngram_jaccard":
            want = brute_components({i: shingles(t) for i, t, _ in rows})
            assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows if want[i] == i)
        if name == "suffix_dedup":
            want = brute_repeats([(i, t) for i, t, _ in rows])
            assert {r.doc_id: r.text for r in got} == {i: want[i][3].decode("utf-8", "ignore") if want[i][1] else t for i, t, _ in rows}
        if name == "mixing":
            taken, _ = plain_mix([(i, len(WORD.findall(t or "")), s) for i, t, s in rows])
            assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for (i, t, _), n in zip(rows, taken, strict=True) for _ in range(n))
        if name == "packing":
            once = {}
            for i, t, _ in rows:
                once[i] = (t, once.get(i, (t, 0))[1] + 1)
            pieces = {}
            for r in got:
                pieces.setdefault((r.doc_id, r.piece), []).append(r)
            assert all(len(rs) == once[i][1] for (i, _), rs in pieces.items())
            assert docs.filter("offset + length > 1024").count() == 0
    # The last stage again on documents without repetition.
    single = before.dropDuplicates(["doc_id"])
    check_packed(corpus_pipeline.packed(spark, single, FOLDER).collect(), [(r.doc_id, r.text) for r in single.select("doc_id", "text").collect()])


def test_pipeline_shuffles_doubtful_texts(spark):
    """The stage of near copies shuffles no text that has none, and drops those that do."""
    import corpus_pipeline
    from test_text_operators import mostly_alone, shuffled

    docs, size = mostly_alone(spark)
    got, moved = shuffled(spark, lambda: corpus_pipeline.without_near_copies(spark, docs, FOLDER).collect())
    assert sorted(r.doc_id for r in got) == list(range(600))
    assert moved < 0.7 * size


AWKWARD = "doc_id long, text string, source string, n_chars long, _id long, _runs string, _copies int, row_id string, copies int, text_ string, id int, runs int, score double, label int, key string, t string, v long, sequence_id long"


def test_pipeline_awkward_rows(spark):
    """Stages over shared and missing ids, nulls, empty texts, repeated rows, long texts and columns named like the stages' own."""
    import corpus_pipeline
    from test_text_operators import WORD

    rng = random.Random(19)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = fresh(40)
    texts = [(1, fresh(50), "a"), (1, fresh(60) + " " + passage, "a"), (1, fresh(30), "b"), (None, fresh(40), None), (None, passage + " " + fresh(20), "a"), (None, None, "b"), (2, None, "a"), (3, "", None), (4, fresh(20_000), "c"), (5, fresh(80), "b"), (5, fresh(80), "b")]
    texts += [(6, fresh(9), "a")] * 3
    docs = spark.createDataFrame([(i, t, s, None, 1, "r", 2, "x", 3, "y", 4, 5, 0.5, 1, "k", "t", 6, 7) for i, t, s in texts], AWKWARD).repartition(3)
    for empty in (docs.limit(0), spark.createDataFrame([], AWKWARD)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, FOLDER).count() == 0, name
    kept = corpus_pipeline.without_toxic(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    kept = corpus_pipeline.without_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 2
    cut = corpus_pipeline.without_repeated_passages(spark, docs, FOLDER)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    lost = {(r.doc_id, len(r.text or "")) for r in cut.collect()} - {(i, len(t or "")) for i, t, _ in texts}
    assert len(lost) == 1 and next(iter(lost))[0] is None  # only the later row with the passage lost it
    mixed = corpus_pipeline.mixed(spark, docs, FOLDER)
    sizes = [(i, len(WORD.findall(t or "")), s) for i, t, s in texts]
    taken, _ = plain_mix(sizes)
    words = sum(len(WORD.findall(r.text)) for r in mixed.select("text").collect())
    assert mixed.columns == docs.columns and words == sum(n * size for n, (_, size, _) in zip(taken, sizes, strict=True)) <= sum(s[1] for s in sizes)
    check = [(k, t) for k, (_, t, _) in enumerate(texts)]
    numbered = spark.createDataFrame([(k, t, 1, 2) for k, t in check], "doc_id long, text string, sequence_id long, rank long")
    check_packed(corpus_pipeline.packed(spark, numbered, FOLDER).collect(), check)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_by_the_book(spark, seed):
    from quillspark.llm import mixing

    rng = random.Random(seed)
    rows = [(rng.choice([None, k, 7]) if k % 5 == 0 else k, rng.choice([0, 1, 3, 40, 900]), rng.choice([None, "a", "B", "é", "z", f"own{k}"])) for k in range(80)]
    frame = spark.createDataFrame([(i, "w " * n if n else rng.choice([None, "", "\t "]), s, k) for k, (i, n, s) in enumerate(rows)], "doc_id long, text string, source string, key long").repartition(3)
    got = {r.key: r for r in mixing.mix(frame, keep=("key",)).collect()}
    taken, target = plain_mix(rows)
    assert all(got[k]["size"] == n and got[k].target == pytest.approx(target[s]) for k, (_, n, s) in enumerate(rows))
    # Rows of one doc_id and size are interchangeable.
    group = lambda counts: sorted((repr(rows[k]), n) for k, n in counts)
    assert group((k, r.copies) for k, r in got.items()) == group(enumerate(taken))


def test_executors_without_the_package(tmp_path):
    """Workers that can't import this package still run op2 and op9."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
sys.path.remove({root!r})
print("rows", [queries[n](spark, {FOLDER!r}).count() for n in ("op2_quality", "op9_langid")])
queries["op2_quality"](spark, {FOLDER!r}).write.format("noop").mode("overwrite").save()
queries["op9_langid"](spark, {FOLDER!r}).write.format("noop").mode("overwrite").save()
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "done" in ran.stdout, ran.stderr[-2000:]
