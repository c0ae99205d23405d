"""Operators on documents against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import base, fingerprints, jaccard, langid, mixing, packing, quality, suffix_dedup, toxicity
from quillspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for k in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 20, 80, 150])))
        if k % 4 == 1:
            t = passage + " " + t
        if k % 6 == 2 and texts:
            t = texts[rng.randrange(len(texts))] or t
        if k % 7 == 3 and texts:
            w = (texts[rng.randrange(len(texts))] or "x y").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", " \n\t ", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 12, "é" * 150, "one two", "one  two", "ONE two"]
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None, 7, 8) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_links(sets):
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    return {i: sum(bool(linked(a, b)) for j, b in sets.items() if i != j) for i, a in sets.items()}


@pytest.mark.parametrize("options", [{}, {"long_list": 1}, {"block_rows": 2}, {"common_limit": 0, "block_rows": 3}])
def test_jaccard(docs, rows, options):
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = brute_components(sets)
    links = brute_links(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_groups(docs, **options).collect()}
    assert got == {i: (len(sets[i]), want[i], links[i]) for i in sets}


def thue_morse(n, odd=False):
    return "".join("ab"[(bin(k).count("1") + odd) % 2] for k in range(n))


def test_jaccard_shared_ids(spark):
    """Rows that share a doc_id, or have none, are documents of their own; words that fool polynomial hashes stay apart."""
    a, b, c = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "alpha beta gamma delta epsilon zeta")
    rows = [(5, a), (5, b), (3, b + " more"), (None, c), (8, c), (None, c + " "), (9, ""), (10, thue_morse(1024)), (11, thue_morse(1024, True)), (5, a)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_links int, id int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_groups(docs, percent=60).collect()), key=repr)
    want = [(5, 4, 5, 1), (5, 4, 5, 1), (5, 2, 3, 1), (3, 3, 3, 1), (None, 2, 8, 2), (8, 2, 8, 2), (None, 2, 8, 2), (9, 0, 9, 0), (10, 1, 10, 0), (11, 1, 11, 0)]
    assert got == sorted(want, key=repr)


def shuffled(spark, run):
    """What run returns, and the bytes that Spark shuffled for it."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    found = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = stages()
    return found, sum(after.apply(k).shuffleWriteBytes() for k in range(after.size()) if after.apply(k).stageId() not in before)


def mostly_alone(spark):
    """Long texts without copies, but for two pairs of near copies; their bytes."""
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(100)) for _ in range(600)]
    texts += [texts[3] + " x", texts[4] + " y"]
    return base.materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), sum(map(len, texts))


def test_jaccard_shuffles_needed_texts(spark):
    """Texts without near copies stay where they are."""
    docs, size = mostly_alone(spark)
    got, moved = shuffled(spark, lambda: jaccard.similar_groups(docs).filter("doc_id <> component_id").collect())
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(600, 3, 1), (601, 4, 1)]
    assert moved < 0.7 * size


def test_shuffles_go_with_their_write(spark):
    """Shuffle files of a result that has been written are gone, and the setting is as before."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks()) if b.isShuffle()}
    before, setting = held(), spark.conf.get(base.SHUFFLE_CLEANUP)
    found = base.materialize(spark.range(1000).repartition(3, "id").groupBy("id").count())
    until = time.time() + 20  # files go soon after the write
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before
    assert found.count() == 1000 and spark.conf.get(base.SHUFFLE_CLEANUP) == setting


def test_split_by_marks(spark):
    """No id is ruled out wrongly, even where ids share all words; the other part holds nulls and most others."""
    docs = spark.createDataFrame([(k, "t") for k in range(-2000, 2000)] + [(None, "t"), (7, "t")], "id long, mark_word string")
    ids = docs.filter("id % 10 = 7").select("id")
    for words in (1, 1 << 18):
        may, rest = base.split_by_marks(docs, "id", ids, words)
        may, rest = [r.id for r in may.collect()], [r.id for r in rest.collect()]
        assert sorted(map(str, may + rest)) == sorted(str(r.id) for r in docs.collect()) and None in rest
        assert {k for k in range(-2000, 2000) if k % 10 == 7 and k > 0} <= set(may) and not any(k is not None and k > 0 and k % 10 == 7 for k in rest)
    assert len(may) < 500
    may, rest = base.split_by_marks(docs, "id", ids.limit(0))
    assert may.count() == 0 and rest.count() == docs.count()


def test_jaccard_empty_and_repeated(spark, none, rows):
    assert jaccard.similar_groups(none).count() == 0
    twice = spark.createDataFrame([rows[1], rows[1], (None, "a b c d e f", None, None, None, 0, 0)], SCHEMA)
    got = [(r.doc_id, r.component_id) for r in jaccard.similar_groups(twice).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (None, None)]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 200, 2)] + [(k, k + 2) for k in range(0, 60, 2)] + [(500, 3), (7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    one = {r.node: r.root for r in components(frame).collect()}
    assert one == {r.node: r.root for r in components(frame, one_task=0).collect()}
    assert one[61] == 0 and one[63] == 62 and one[500] == 0 and 0 not in one and 7 in one


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(c for c, x in zip(raw, covered, strict=True) if not x)
        out[i] = (len(raw), sum(covered), len(re.findall(b"\1+", bytes(covered))), kept)
    return out


def cuts(docs):
    found = suffix_dedup.without_repeats(docs)
    rows = found.frame.select(found.columns["doc_id"], found.columns["text"], found.cut.alias("cut")).collect()
    return [(r[0], r[1], r[2]) for r in rows]


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, rows, hot, monkeypatch):
    whole = suffix_dedup.repeated_runs
    monkeypatch.setattr(suffix_dedup, "repeated_runs", lambda d, n: whole(d, n, hot))
    got = {i: tuple(cut) for i, _, cut in cuts(docs)}
    assert {k: (a, b, c, bytes(d)) for k, (a, b, c, d) in got.items()} == brute_repeats(rows)


def test_suffix_dedup_cases(spark, none):
    assert cuts(none) == []
    text = "".join(chr(97 + (k * k) % 23) + str(k) for k in range(80))
    rows = [(3, text), (3, text), (None, text), (5, "x" * 350), (1, None)]
    got = sorted(((i, cut.n_removed) for i, _, cut in cuts(spark.createDataFrame(rows, "doc_id long, text string"))), key=str)
    assert got == sorted([(3, 0), (3, 0), (None, len(text)), (5, 349), (1, 0)], key=str)


def test_suffix_dedup_shared_ids(spark):
    """Rows without a doc_id, and rows of one doc_id with different texts, are documents of their own."""
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage, copy = fresh(150), fresh(260)
    rows = [(7, fresh(300)), (None, fresh(400)), (None, fresh(40) + passage + fresh(200)), (None, fresh(90) + passage + fresh(50)), (None, copy), (None, copy), (4, fresh(60) + passage), (4, fresh(380)), (4, copy[:180]), (9, "same " * 60), (9, "same " * 60), (None, None), (None, "")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(((i, t, cut.n_bytes, cut.n_removed, cut.n_spans, bytes(cut.kept)) for i, t, cut in cuts(frame)), key=repr)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    once = [r for k, r in enumerate(ordered) if r[0] is None or r not in ordered[:k]]
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(once)])
    want = [(i, t, *want[k]) for k, (i, t) in enumerate(once)]
    want = sorted([*want, *(w for w in want if w[0] == 9)], key=repr)
    assert got == want
    assert sum(w[3] for w in want if w[0] is None) >= 2 * 150 + 260


def test_near_copies_without_ids(spark):
    import corpus_pipeline

    texts = [" ".join(f"w{k}x{n}" for n in range(30)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (3, texts[1]), (None, texts[2] + " more"), (None, texts[2]), (5, texts[3]), (5, texts[3]), (6, "other words than these")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == sorted([(None, texts[0]), (3, texts[1]), (None, texts[2]), (5, texts[3]), (6, "other words than these")], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60) | st.sampled_from([b"", b"a" * 40, b"a" * 40 + b"\0", b"a" * 41, b"\0" * 33, b"\0" * 34]), max_size=40))
def test_deep_shallow(strings):
    order, lcp = suffix_dedup.deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert lcp[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


def test_anchors_of_long_text():
    text = bytes(np.random.default_rng(1).integers(97, 122, 5000, dtype=np.uint8))
    whole = {}
    for number, start, windows, before, anchor in suffix_dedup.Anchors(100).of([text]):
        for s, w, b, h in zip(start.tolist(), windows.tolist(), before.tolist(), anchor.tolist(), strict=True):
            whole.update({p: (s + b, h) for p in range(s, s + w)})
    cut = {}
    for number, start, windows, before, anchor in suffix_dedup.Anchors(100, block=700).of([text]):
        for s, w, b, h in zip(start.tolist(), windows.tolist(), before.tolist(), anchor.tolist(), strict=True):
            cut.update({p: (s + b, h) for p in range(s, s + w)})
    assert whole == cut and len(whole) == 4901


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == sizes
    per_source = collections.defaultdict(int)
    for r in got:
        per_source[r.source] += r["size"]
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in got)
    for source, target in targets.items():
        taken = sum(r.taken for r in got if r.source == source)
        assert abs(taken - target) <= max(sizes.values()) and target <= 3 * per_source[source] + 1e-6
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none).count() == 0


def test_mixing_limits(spark):
    rows = [(k, "w " * 10, "a") for k in range(90)] + [(100, "w " * 10, "b"), (101, "w " * 10, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    assert targets == {"a": 860.0, "b": 30.0, None: 30.0}
    assert {r.copies for r in got.filter("source = 'b' or source is null").collect()} == {3}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_paths()[0])


def test_packing(docs, rows, tokenizer, none):
    got = packing.pack_documents(docs, capacity=64).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    import zlib

    total = 0
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 64)
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        total += len(ids)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-total // 64) * 1.1 + 1
    assert packing.pack_documents(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n a  'sé1.<|endoftext>Z", max_size=30), max_size=8))
def test_byte_bpe(texts):
    from tokenizers import Tokenizer

    coder = test_byte_bpe.__dict__.setdefault("coder", packing.ByteBpe(*packing.public_paths()))
    plain = test_byte_bpe.__dict__.setdefault("plain", Tokenizer.from_file(packing.public_paths()[0]))
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.batch([t.encode() for t in texts])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe_adversarial(tokenizer):
    """Parts that polynomial hashes modulo a power of two can't tell apart."""
    texts = ["x " + thue_morse(1024), "x " + thue_morse(1024, True), "x " + thue_morse(2048), "x " + thue_morse(2048, True)]
    coder = packing.ByteBpe(*packing.public_paths())
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.batch([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("runs", [{60: 10, 40: 10, 30: 5, 10: 7}, {k: 3 for k in range(1, 100)}, {1: 1000, 99: 2}, {51: 9, 50: 9}])
def test_best_fit_rounds(spark, runs):
    frames, sequences = packing.best_fit_rounds(spark.createDataFrame(list(runs.items()), "size long, count long"), 100)
    used, ranks = collections.Counter(), collections.defaultdict(list)
    for frame in frames:  # in the order of rounds
        for r in sorted(frame.filter("kind = 2").collect(), key=lambda r: r["offset"]):
            ranks[r["size"]] += range(r["first"], r["first"] + r["count"])
            for k in range(r["count"]):
                assert used[r["sequence"] + k] == r["offset"]
                used[r["sequence"] + k] += r["size"]
    assert {size: sorted(x) for size, x in ranks.items()} == {size: list(range(n)) for size, n in runs.items()}
    assert max(used.values()) <= 100 and len(used) == sequences
    # No worse than best fit in descending order, piece by piece, by more than one in fifty.
    gaps, opened = [], 0
    for size in sorted((size for size, n in runs.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            opened += 1
            gaps.append(100 - size)
    assert sequences <= 1.02 * opened


def test_fingerprints(docs, rows, none, spark):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ordered = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    same = {}
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert same.setdefault(text, r.fingerprint) == r.fingerprint and same.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == changed:
            assert r.near_edited == 1
    assert len(set(same.values())) == len(same)
    assert fingerprints.edited_fingerprints(none).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


@pytest.mark.parametrize(("most_cuts", "some"), [(4096, [None, None, None, 7, 7, 7]), (3, [None, None, None, 7, 7, 7]), (3, [None]), (4096, [None, (1 << 63) - 1])])
def test_fingerprints_shared_ids(spark, most_cuts, some):
    """Rows that share a doc_id or have none, dense and sparse ids; likeness against the span sets themselves."""
    rng = random.Random(17)
    rows = [(i, "".join(rng.choice("abc d") for _ in range(rng.randint(0, 90)))) for i in [*range(60), 10**15, -(10**12), *some]]
    frame = spark.createDataFrame([(i, t, "p", 1, True) for i, t in rows], "doc_id long, text string, part string, id long, copy boolean").repartition(4)
    got = sorted(((r.doc_id, r.edited_sha256, r.near_next) for r in fingerprints.edited_fingerprints(frame, most_cuts).collect()), key=repr)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []

    def hashes(text):
        return set(fingerprints.PrefixHash(fingerprints.code_points(text), fingerprints.Powers()).least().tolist())

    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        x, y = hashes(text), hashes(following)
        both = sorted(x | y)[: fingerprints.KEEP]
        near = 1.0 if text == following else sum(h in x and h in y for h in both) / len(both) if x and y else 0.0
        want.append((i, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest(), near))
    assert got == sorted(want, key=repr)


def test_likeness_estimates_jaccard():
    """near_edited and near_next are near the Jaccard similarity of the sets of 16-character spans."""
    rng = random.Random(18)
    powers = fingerprints.Powers()
    wrong = []
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(600))
        cut = rng.randrange(600)
        other = text[:cut] + "".join(rng.choice("abcdefgh ") for _ in range(600 - cut))
        x, y = ({t[k : k + 16] for k in range(len(t) - 15)} for t in (text, other))
        a, b = (fingerprints.PrefixHash(fingerprints.code_points(t), powers).fingerprint() for t in (text, other))
        wrong.append(fingerprints.likeness(a, b) - len(x & y) / len(x | y))
    assert abs(sum(wrong) / len(wrong)) < 0.03 and max(map(abs, wrong)) < 0.35


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abé", max_size=60), st.text(alphabet="abé", max_size=60), st.data())
def test_prefix_hash(x, y, data):
    powers = fingerprints.Powers()
    a, b = (fingerprints.PrefixHash(fingerprints.code_points(t), powers) for t in (x, y))
    i, j = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    want = next((n for n in range(min(len(x) - i, len(y) - j)) if x[i + n] != y[j + n]), min(len(x) - i, len(y) - j))
    assert a.extension(i, b, j) == want
    assert a.span(i, want) == b.span(j, want)


def test_toxicity(spark):
    rng = random.Random(4)
    clean = ["blue", "house", "river", "garden", "letter", "window", "market", "bridge"]
    rows = []
    for k in range(400):
        words = [rng.choice(clean) for _ in range(30)]
        if k % 8 == 0:
            words[rng.randrange(30)] = rng.choice(["wretch", "wretched", "vermins"])
            words[rng.randrange(30)] = "wretch"
        rows.append((k, " ".join(words), int(k % 8 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.learn(frame, frame.select("doc_id", "label").filter("doc_id % 5 <> 0"))
    from pyspark.sql import functions as F

    got = {r.doc_id: r.s for r in frame.select("doc_id", toxicity.score(F.col("text"), lexicon).alias("s")).collect()}
    assert all((got[k] >= 0.5) == bool(label) for k, _, label in rows)
    odd = spark.createDataFrame([(None,), ("",), ("WRЕТСH house",), ("wr3tch house",), ("my wretch house " * 2000,)], "text string")
    scores = [r[0] for r in odd.select(toxicity.score(F.col("text"), lexicon)).collect()]
    assert scores[0] < 0.5 and scores[1] < 0.5 and min(scores[2:]) >= 0.5
    excepted = toxicity.Lexicon(lexicon.weights, ("dear wretch",), lexicon.slope, lexicon.offset)
    assert excepted.measure("my dear wretch", excepted.automaton()) == 0 < excepted.measure("my wretch", excepted.automaton())
    assert toxicity.learn(frame, frame.select("doc_id", "label").limit(0)).probability(0.0) < 0.5


def plain_toxicity(lexicon, text):
    """The score by a plain reading of the lexicon, without an automaton."""
    words = toxicity.fold(text or "").split()
    stretch = " " + " ".join(words) + " "

    def places(pattern):
        return [(m.start(), m.start() + len(pattern.rstrip())) for m in re.finditer(f"(?={re.escape(pattern)})", stretch)]

    excepted = [p for phrase in lexicon.exceptions for p in places(re.sub(" +", " ", " " + toxicity.fold(phrase)))]
    hits = [(p, w) for stem, w in lexicon.weights.items() for p in places(" " + stem)]
    total = sum(w for (a, b), w in hits if not any(x <= a and b <= y for x, y in excepted))
    x = lexicon.slope * total / max(1, len(words)) ** lexicon.power + lexicon.offset
    return 1 / (1 + np.exp(-max(-40, min(40, x))))


def test_toxicity_words_of_any_length(spark):
    """Toxic words of three, nine and 300 letters, the longer ones with clean words of the same first eight; exceptions; a plain reading."""
    rng = random.Random(14)
    clean = ["blue", "house", "river", "garden", "letter", "abcdefghij", "y" * 299 + "x", "zap"]
    rows = []
    for k in range(900):
        words = [rng.choice(clean) for _ in range(30)]
        if k % 6 == 0:
            words[rng.randrange(30)] = ["zog", "abcdefghk", "y" * 300][k // 6 % 3]
        elif k % 30 == 25:
            words[7:9] = ["dear", ["zog", "abcdefghk"][k // 30 % 2]]
        rows.append((k, " ".join(words) if k % 10 else ", ".join(words), int(k % 6 == 0), 0.5, 1, "x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int, score double, predicted int, stem string").repartition(3)
    lexicon = toxicity.learn(frame, frame.select("doc_id", "label").filter("doc_id % 5 <> 0"), exceptions=("Dear zog", "dear abcdefghk"))
    from pyspark.sql import functions as F

    odd = [(10_000, None), (10_001, ""), (10_002, "Z0G"), (10_003, "dear zog zog dear  zog"), (10_004, "zog blue " * 30_000)]
    every = frame.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in every.select("doc_id", toxicity.score(F.col("text"), lexicon).alias("s")).collect()}
    texts = {r[0]: r[1] for r in [*rows, *odd]}
    assert all(got[i] == pytest.approx(plain_toxicity(lexicon, t), abs=1e-9) for i, t in texts.items())
    assert all((got[r[0]] >= 0.5) == bool(r[2]) for r in rows) and got[10_002] >= 0.5
    assert frame.limit(0).select(toxicity.score(F.col("text"), lexicon)).count() == 0


def plain_quality(model, text):
    """The score by a plain reading: every token by itself."""
    words = (text or "").split()
    tokens = []
    for k, w in enumerate(words):
        start = next((i for i, c in enumerate(w) if re.match(r"\w", c)), len(w))
        end = next((i for i in range(len(w), start, -1) if re.match(r"\w", w[i - 1])), start)
        core = w[start:end]
        kind = "digits" if core.isdigit() else "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() else "lower" if core.isalpha() else "mixed" if core else "none"
        tokens += [core.lower(), f"<{kind}{min(len(core), 20) // 4}", *([f"<{w[:start][:4]}_{w[end:][:4]}"] if start or end < len(w) else [])]
        tokens += ["<again"] if k and words[k - 1] == w else []
    rows = [model.vectors[model.vocabulary[t]].astype(float) for t in tokens if t in model.vocabulary]
    x = np.append(np.mean(rows, 0) if rows else np.zeros(model.vectors.shape[1]), np.log1p(len(words)) / 10)
    net = model.network
    hidden = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1)
    return 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature))


def test_quality_long_words(spark):
    """A word of 400 letters tells good from bad as any other would."""
    rows = [(k, f"some words {'z' * 400 if k % 3 == 0 else 'y' * 400} and more", int(k % 3 == 0)) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(frame, frame.select("doc_id", "label"))
    assert "z" * 400 in model.vocabulary
    got = model.scores([t for _, t, _ in rows], {})
    assert all((s >= 0.5) == bool(y) for s, (_, _, y) in zip(got, rows, strict=True))


def test_word_vectors_do_not_depend_on_cuts():
    """Sums over texts that are cut within a text and read by several tasks are those of one reading."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["ab", "Cd", "ef!", "12"]) for _ in range(n)) for n in (5, 100_050, 3)]
    counts = sorted(quality.spread(texts).items())
    indexed = quality.Indexed(counts, 3, 16, 3)
    whole = indexed.sums(texts, 2)
    assert np.allclose(whole, sum(indexed.sums([t], 2) for t in texts))
    x = indexed.sums(["ab Cd ef! ab"], 2)
    ids = [[indexed.vocabulary.get(f, -1) for f in quality.forms(w)] for w in "ab Cd ef! ab".split()]
    want = np.zeros_like(x)
    for i in range(4):
        for j in range(4):
            for a in ids[i]:
                for b in ids[j]:
                    if abs(i - j) <= 2 and a != b and a >= 0 and b >= 0:
                        np.add.at(want, (a, indexed.place[b]), indexed.rarity[b] * indexed.sign[b] * (2 if i == j else 1))
    assert np.allclose(x, want)


def test_word_vectors_of_rare_tokens(monkeypatch):
    """Pairs of frequent tokens, of rare ones and of both, in texts that are cut or not, add up to what a plain reading finds."""
    rng = random.Random(17)
    words = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in ("", "x", ".", "!?", "X", "7")]
    texts = [" ".join(rng.choices([*words, "so", "so", "unknown"], k=n)) for n in (0, 1, 40, 700, 333)]
    counts = [c for c in quality.spread(texts).most_common() if c[0] != "unknown"]
    indexed = quality.Indexed(counts, len(texts), 16, 3)
    want = np.zeros((len(counts), 16))
    for t in texts:
        split = t.split()
        forms = [[*quality.forms(w), *(["<again"] if k and split[k - 1] == w else [])] for k, w in enumerate(split)]
        ids = [[indexed.vocabulary[f] for f in own if f in indexed.vocabulary] for own in forms]
        for i, own in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                for a in own:
                    for b in ids[j]:
                        if a != b:
                            want[a, indexed.place[b]] += indexed.rarity[b] * indexed.sign[b] * (2 if i == j else 1)
    for hot, cut in ((128, 100_000), (3, 100_000), (5, 50), (1000, 7)):
        monkeypatch.setattr(quality, "HOT", hot)
        monkeypatch.setattr(quality, "CUT", cut)
        assert len(counts) > 128 and np.allclose(indexed.sums(texts, 2), want)


def test_quality_work(monkeypatch):
    """A text's score reads a vector once for each of its tokens, not for each of its words; neighbours are added up without sorting all pairs."""
    rng = random.Random(18)
    words = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in ("", "x", ".", "!?", "X", "7")]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    indexed = quality.Indexed(quality.spread(texts).most_common(), len(texts), 16, 3)
    read, compared = [], []

    class Vectors(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]

    unique = np.unique
    with monkeypatch.context() as patch:
        patch.setattr(np, "unique", lambda a, *args, **named: compared.append(np.size(a)) or unique(a, *args, **named))
        vectors = indexed.unit(indexed.sums(texts, 2))
    assert sum(compared) <= 4 * 300 * len(texts)
    model = quality.Classifier(indexed.vocabulary, vectors.view(Vectors), quality.Network.start(np.zeros(17), np.ones(17)))
    got = model.scores(texts, {})
    assert sum(read) <= sum(quality.spread([t]).total() for t in texts)
    assert got == pytest.approx([plain_quality(model, t) for t in texts], abs=1e-9)
    monkeypatch.setattr(quality, "CUT", 50)  # texts are read in pieces
    assert model.scores(["a a " * 60, *texts], {}) == pytest.approx([plain_quality(model, t) for t in ["a a " * 60, *texts]], abs=1e-9)


def test_quality(spark):
    rng = random.Random(5)
    words = ["blue", "house", "river", "garden", "letter", "window"]
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))
        good = k % 4 != 0
        rows.append((k, text if good else text.upper().replace(" ", "!! "), int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(frame, frame.select("doc_id", "label").filter("doc_id % 3 <> 0"))
    from pyspark.sql import functions as F

    got = {r.doc_id: r.s for r in frame.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()}
    right = [(got[k] >= 0.7) == bool(label) for k, _, label in rows if k % 3 == 0]
    assert sum(right) / len(right) > 0.95 and all(0 <= s <= 1 for s in got.values())
    odd = [(None,), ("",), ("x" * 100000,), ("Blue " + "(" * 20000 + "house" + "!" * 20000 + " blue blue",), ("river " * 30000,)]
    found = spark.createDataFrame(odd, "text string").select("text", quality.score(F.col("text"), model)).collect()
    assert all(r[1] == pytest.approx(plain_quality(model, r[0]), abs=1e-6) for r in found)
    assert all(got[k] == pytest.approx(plain_quality(model, t), abs=1e-6) for k, t, _ in rows[:60])
    assert quality.learn(frame, frame.select("doc_id", "label").limit(0)).scores(["a"], {}).tolist() == [0.5]


def test_quality_learns_from_all_rows(spark):
    """Every labelled row counts: words of the last few of many rows, whichever they are, tell good from bad; trained by several tasks."""
    rows = [(k, f"plain words number {k % 50} {'fine' if k % 2 else 'Poor!!'} here", k % 2) for k in range(7000)]
    rows += [(7000 + k, f"rare{k} mark{k % 2} mark{k % 2}", k % 2) for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(frame, frame.select("doc_id", "label"), task_rows=2000)
    assert {"mark0", "mark1", "fine", "poor"} <= set(model.vocabulary)
    got = model.scores([t for _, t, _ in rows[:400]], {})
    assert all((s >= 0.5) == bool(y) for s, (_, _, y) in zip(got, rows, strict=False))
    again = quality.learn(frame, frame.select("doc_id", "label"), task_rows=2000)
    assert np.allclose(got, again.scores([t for _, t, _ in rows[:400]], {}))


def test_langid(spark, none):
    texts = {"en": "the house and the river with the garden that is in the town ", "de": "das haus und der fluss mit dem garten der in der stadt ist ", "fr": "la maison et la rivière avec le jardin qui est dans la ville "}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.sample(t.split(), 8)), lang) for k, (lang, t) in enumerate(list(texts.items()) * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.learn(frame.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in langid.predict(frame, parser).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows if k % 5 == 0)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, texts["de"] * 3000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(odd, parser).orderBy("doc_id").collect()] == ["und", "und", "und", "de"]
    assert langid.predict(odd, langid.learn(none)).filter("lang_pred <> 'und' or score <> 0").count() == 0


def plain_parse(text, sample):
    """Phrases of a text, each the longest string that occurs in the sample (one symbol at least)."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé ", min_size=1, max_size=60), st.text(alphabet="abcdéя中 ", max_size=200) | st.builds(lambda x, n: x * n, st.text(alphabet="ab ", max_size=5), st.integers(1, 60)))
def test_cross_parsing(sample, text):
    samples = {"x": [sample, "a"], "y": ["c" + sample[::-1], "яб"]}
    parser = langid.CrossParser.learn(samples)
    parser.stretch = 7
    own = langid.folded(text)
    if own:
        got = parser.entropies([parser.encode(text), parser.encode("ab " + text)])
        for k, name in enumerate(parser.languages):
            held = b" ".join(filter(None, map(langid.folded, samples[name])))
            assert got[0][k] == pytest.approx(plain_parse(own, held) * parser.bits[k] / len(own))
            other = langid.folded("ab " + text)
            assert got[1][k] == pytest.approx(plain_parse(other, held) * parser.bits[k] / len(other))


def plain_language(samples, text, sample=16_000):
    own = langid.folded(text or "")
    bits = []
    for language in sorted(samples):
        held = b" ".join(filter(None, map(langid.folded, samples[language])))[:sample]
        bits.append((plain_parse(own, held) * np.log2(len(held) + 1) / max(1, len(own)), language))
    bits.sort(key=lambda x: x[0])
    return (bits[0][1], 1 - bits[0][0] / bits[1][0]) if own else ("und", 0.0)


def test_langid_scripts(spark):
    """Languages of many letters, and of one script each; letters that stand only late in texts; a plain reading."""
    rng = random.Random(15)
    han, kana, greek = [chr(0x4E00 + 7 * k) for k in range(900)], [chr(0x3041 + k) for k in range(80)], [chr(0x3B1 + k) for k in range(17)]
    say = {"zh": lambda: "".join(rng.choice(han) for _ in range(40)), "ja": lambda: "".join(rng.choice(han[:300] + kana * 6) for _ in range(40)), "el": lambda: " ".join("".join(rng.choice(greek) for _ in range(5)) for _ in range(8)), "xx": lambda: "1 2 3 " * 400 + "abc abd abe " * 3}
    rows = [(None if k % 3 else k, say[lang](), lang, 0.5, "u", True) for k, lang in enumerate(list(say) * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, held_out boolean").repartition(3)
    parser = langid.learn(frame)
    assert parser.languages == sorted(say)
    fresh = [(k, say[lang](), lang) for k, lang in enumerate(list(say) * 10)] + [(100, None, "und"), (101, "", "und"), (102, "½ 3 _", "und"), (103, say["el"]() * 500, "el")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, score string"), parser).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in fresh)
    starts = [*parser.starts.tolist(), len(parser.table) // parser.width]
    assert all(b - a <= 2 * 16_000 for a, b in zip(starts, starts[1:]))
    # A plain reading of the same samples gives the same languages and scores.
    small = {"de": ["der hund und die katze"], "en": ["the dog and the cat"], "el": ["ο σκύλος και η γάτα"]}
    parser = langid.CrossParser.learn(small)
    for text in ["the cat", "die katze und der hund " * 300, "γάτα και 7 the", "", None, "9"]:
        names, scores = parser.predict([text or ""])
        assert (names[0], scores[0]) == (plain_language(small, text)[0], pytest.approx(plain_language(small, text)[1]))


def test_repeated_and_tied_rows(spark, none):
    """op1, op2 and op9 on columns that clash with theirs, repeated rows, nulls everywhere and an empty table."""
    from pyspark.sql import functions as F

    rows = [(k, f"good text number {k} here", "en", k % 2) for k in range(40)] + [(None, "same", None, None), (None, "same", None, None), (7, None, None, None), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1.0, True, 3) for r in rows], "doc_id long, text string, lang string, label int, score double, held_out boolean, n long")
    labelled = frame.select("doc_id", "label").filter("label is not null")
    for score in (toxicity.score(F.col("text"), toxicity.learn(frame, labelled)), quality.score(F.col("text"), quality.learn(frame, labelled))):
        found = frame.select("doc_id", "text", score.alias("s")).collect()
        assert len(found) == len(rows) and all(0 <= r.s <= 1 for r in found)
        assert len({r.s for r in found if r.text == "same"}) == 1 and len({r.s for r in found if r.text is None}) == 1
        assert none.select(score.alias("s")).count() == 0
    assert quality.learn(none, labelled.limit(0)).constant == 0.5
    assert langid.predict(none, langid.learn(frame)).count() == 0 and langid.predict(frame, langid.learn(frame)).count() == len(rows)
