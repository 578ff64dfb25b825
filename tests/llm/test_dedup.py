"""Exact, near and substring duplicates, against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import common as C
from cairn.llm import exact, repeats, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, k1 string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None, partitions=3):
    rows = [(ids[k] if ids else k, t, "en", "s", 0, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def folder(df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def prose(rng, n, words=60):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(words)) for _ in range(n))


# --- exact ---------------------------------------------------------------------------------------------

TEXTS = ["a b", "ab", "a\tb\n", None, "", " \n", "A b", "a b", "ab", "long " * 5000, "long" * 5000, "x"]


def test_exact_groups(spark, tmp_path):
    ids = [5, 3, 9, 1, 2, 0, 7, 8, 3, 10, 11, 12]
    rows = exact.op7_exact(spark, folder(docs(spark, TEXTS, ids, 5), tmp_path)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS]
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, t, n in zip(ids, TEXTS, norm, strict=True):
        groups.setdefault(n, []).append((-len(t or ""), i))
    want = Counter((i, min(groups[n])[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


@pytest.mark.parametrize("fan_in", [2, 8])
def test_tree_merge_of_many_runs(spark, fan_in):
    texts = [f"t{k % 7}" for k in range(200)]
    runs = exact.digests(docs(spark, texts, partitions=13))
    from pyspark.sql import functions as F

    own = runs.groupBy("__run", "__digest", "__check", "__bytes").agg(F.min("__id").alias("__best"), F.count(F.lit(1)).alias("__rows"))
    got = sorted((r["__best"], r["__rows"]) for r in exact.tree_merge(own, fan_in).collect())
    assert got == sorted((k, texts.count(f"t{k}")) for k in range(7))


def test_exact_deduplicated_rows(spark):
    df = docs(spark, ["a", "a ", "a", None, "b"], [1, 2, 1, None, 4])
    rows = exact.deduplicated(df).collect()
    assert df.columns == list(rows[0].asDict()) and sorted((str(r["doc_id"]), r["text"]) for r in rows) == [("2", "a "), ("4", "b"), ("None", None)]
    same = docs(spark, ["a"] * 40, [7] * 40)
    assert exact.deduplicated(same).count() == 1
    assert exact.exact_groups(docs(spark, [])).count() == 0 and exact.deduplicated(docs(spark, [])).count() == 0


# --- near ----------------------------------------------------------------------------------------------


def fingerprint(text, words=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(items, linked):
    """The smallest item of each item's component."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: min(items[k] for k in range(len(items)) if label[k] == label[i]) for i in range(len(items))}


def test_components(spark, tmp_path):
    rng = random.Random(2)
    first = prose(rng, 400)
    texts = [first, first.upper(), None, "", "ab", "a b", "Ünï cödé ẞ İ", first + " end", "x\x0by\x1cz w"]
    for _ in range(40):
        words = first.split()
        words[rng.randrange(400)] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) for _ in range(20)]
    ids = list(range(100, 100 + len(texts)))
    rows = simhash.op10_simhash(spark, folder(docs(spark, texts, ids), tmp_path)).collect()
    fps = [fingerprint(t) for t in texts]
    want = grouped(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert len(rows) == len(texts)
    for r in rows:
        k = r["doc_id"] - 100
        assert r["fingerprint"] == f"{fps[k]:016x}" and r["component_id"] == want[k]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), min_size=0, max_size=3), min_size=1, max_size=40))
def test_forests_join_what_links_join(start, flips):
    """Chains of fingerprints, each a few bits from the one before: small, large and split groups give the same components."""
    values = [start]
    for own in flips:
        v = values[-1]
        for b in own:
            v ^= 1 << b
        values.append(v)
    fps = np.array(sorted(set(values)), dtype=np.uint64)[:, None]
    n = len(fps)
    want = grouped(list(range(n)), lambda i, j: (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 3)
    old = simhash.PAIRWISE
    try:
        for pairwise, label in ((2048, np.arange(n)), (4, np.arange(n)), (2048, np.array([want[k] if k % 3 else -1 - k for k in range(n)], dtype=np.int64))):
            simhash.PAIRWISE = pairwise
            joined = simhash.Joined(label)
            for part in simhash.parted(np.arange(n), fps, 3):
                simhash.grow(part, lambda x, others: np.bitwise_count(fps[others] ^ fps[x]).sum(axis=-1) <= 3, joined)
            roots = joined.roots(np.arange(n))
            assert [roots[i] == roots[j] for i in range(n) for j in range(n)] == [want[i] == want[j] for i in range(n) for j in range(n)]
            assert len(joined.links) < n
    finally:
        simhash.PAIRWISE = old


@pytest.mark.parametrize("cut", [0, 1])
def test_variants_meet_at_distance_three(spark, cut):
    """Every pair that a few bits part is found, whichever segments and halves the bits are in; others aren't linked."""
    rng = random.Random(1)
    rows = []
    for k in range(120):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), k % 5):
            b ^= 1 << bit
        rows += [(2 * k, a - 2**63), (2 * k + 1, b - 2**63)]
    fps = spark.createDataFrame([r for r in rows if r[0] % 2 == 0 or r[0] % 10 != 1], "node long, f0 long")
    got = {tuple(r) for r in simhash.links(fps, simhash.SHORT, cut).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(120) if k % 5 in (1, 2, 3)}
    assert simhash.dealt(fps, simhash.SHORT).count() == 4 * fps.count()


def test_hot_deals_are_split(spark, monkeypatch):
    """Many fingerprints in one deal, in blocks of which each two meet, give the same components."""
    rng = random.Random(5)
    start = rng.getrandbits(64)
    values = {start}
    for _ in range(150):
        v = rng.choice(sorted(values))
        for bit in rng.sample(range(64), rng.choice((1, 2, 3, 5))):
            v ^= 1 << bit
        values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in enumerate(values)], "node long, f0 long")
    want = grouped(list(range(len(values))), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    monkeypatch.setattr(simhash, "DEAL", 20)
    got = {r["node"]: r["label"] for r in simhash.candidates(fps, simhash.SHORT).collect()}
    assert all(got.get(k, k) == want[k] for k in want)


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 1, 5, 200, 40, 40, 90)]
    old = simhash.BITMAP
    try:
        for bitmap in (old, 0):
            simhash.BITMAP = bitmap
            shared = simhash.overlaps(sets)
            for x in range(len(sets)):
                assert shared(x, np.arange(len(sets)))[np.arange(len(sets)) != x].tolist() == [len(np.intersect1d(sets[x], s)) for k, s in enumerate(sets) if k != x]
    finally:
        simhash.BITMAP = old


def dense(n, most, rng, words=200):
    """Copies of one text with 1 to ``most`` changed words each."""
    text = prose(rng, words, 5000).split()
    out = []
    for k in range(n):
        own = list(text)
        for at in rng.sample(range(words), 1 + k % most):
            own[at] = f"other{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def by_shingles(texts, words=5):
    """Brute force: the components of texts that share 0.8 of their shingles, as a matrix product."""
    own = [{tuple(t.lower().split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in texts]
    number = {s: k for k, s in enumerate(set().union(*own))}
    has = np.zeros((len(texts), len(number)), dtype=np.float32)
    for k, s in enumerate(own):
        has[k, [number[x] for x in s]] = 1
    both = has @ has.T
    size = has.sum(axis=1)
    linked = 10 * both >= 8 * (size[:, None] + size[None, :] - both)
    label = np.arange(len(texts))
    while True:
        least = np.where(linked, label[None, :], len(texts)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize(("copies", "most", "block"), [(1000, 6, 1 << 20), (400, 6, 8000)])
def test_dense_near_copies(spark, monkeypatch, copies, most, block):
    """Dense groups give exactly the components of brute force, in one block of shingles or in many."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(copies)
    texts = dense(copies, most, rng) + [prose(rng, 150, 5000) for _ in range(20)]
    want = by_shingles(texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, texts), scheme=simhash.WIDE).collect()}
    assert [found[k] for k in range(len(texts))] == want.tolist()


def test_hubs_are_broadcast(spark, monkeypatch):
    edges = [(0, k) for k in range(1, 120)] + [(k, k + 200) for k in range(1, 120)] + [(500, 501), (501, 502)]
    edges = spark.createDataFrame(edges, "a long, b long")
    want = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    monkeypatch.setattr(simhash, "HUBS", 16)
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == want and set(got.values()) == {0, 500}


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[901] == 900
    assert simhash.components(edges.limit(0)).count() == 0


def jaccard(a, b, words=5):
    own = [{tuple(t.lower().split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in (a, b)]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def test_near_duplicates_go(spark):
    """Of documents that share 0.8 of their shingles one stays; others stay."""
    rng = random.Random(7)
    texts, twins = [], []
    for k in range(60):
        text = prose(rng, 200, 5000)
        texts.append(text)
        words = text.split()
        for _ in range(1 + k // 8):
            words[rng.randrange(200)] = "other"
        copy = " ".join(words)
        twins.append((len(texts), jaccard(text, copy)))
        texts.append(copy)
    texts += [prose(rng, 150, 5000) for _ in range(20)]
    half = texts[0].split()[:100] + prose(rng, 100, 5000).split()
    texts.append(" ".join(half))
    stay = {r["doc_id"] for r in simhash.deduplicated(docs(spark, [*texts, None, None, texts[-1]])).collect()}
    near = {k: j for k, j in twins if j >= 0.8}
    assert set(range(len(texts) + 1)) - stay <= set(near), "only copies go"
    assert len(near) >= 25 and not set(near) & stay
    assert simhash.deduplicated(docs(spark, [])).count() == 0
    assert simhash.near_groups(docs(spark, [])).count() == 0


# --- repeats -----------------------------------------------------------------------------------------------


def without_repeats(texts, size=35):
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = [None, "", "one", "w " * 100, "w " * 35, "w " * 34, prose(rng, 34)]
    for k in range(30):
        own = prose(rng, 120)
        cut = rng.randrange(120)
        inner = passage.split()
        a = rng.randrange(0, 30)
        size = (33, 34, 35, 36, 60)[k % 5]
        texts.append(" ".join(own.split()[:cut] + inner[a : a + size] + own.split()[cut:]))
    texts.append(texts[-1])
    texts.append(passage + "\x0b" + passage + "\x1c" + passage)
    texts.append("Ünï" + " " + " ".join(f"é{k}" for k in range(50)))
    texts.append(" ".join(f"é{k}" for k in range(50)) + " tail")
    return texts


@pytest.mark.parametrize("slice_hashes", [1 << 21, 50])
def test_repeats_against_brute_force(spark, slice_hashes):
    texts = repeat_texts()
    df = docs(spark, [*texts, texts[10]], [*range(len(texts)), 10])
    rows = repeats.remove_repeats(df, slice_hashes=slice_hashes).collect()
    want = without_repeats([*texts, texts[10]])
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) == want[r["doc_id"]]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_small_batches_give_the_same(spark, monkeypatch, tmp_path):
    texts = repeat_texts()
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.op9_repeats(spark, folder(docs(spark, texts), tmp_path)).collect()}
    assert rows == dict(enumerate(without_repeats(texts)))
    monkeypatch.setattr(repeats, "BATCH_WORDS", 100)
    run = repeats.packer(repeats.BLOCK, 4, True)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["k1", "k2", "text"])
    table = pa.Table.from_batches(list(run(iter([batch]))))
    assert len(set(table.column("batch").to_pylist())) > 10
    found = pa.concat_tables([repeats.matcher(True)(table.filter(pa.compute.equal(table.column("slice"), s))) for s in range(4)])
    each = pa.concat_tables([repeats.unpack(found.filter(pa.compute.equal(found.column("batch"), b))) for b in set(found.column("batch").to_pylist())])
    hit = dict(zip(each.column("k1").to_pylist(), [np.frombuffer(x, np.uint32).tolist() for x in each.column("places").to_pylist()], strict=True))
    words = [WORD.findall(t or "") for t in texts]
    use = [len(w) >= 35 for w in words]
    blocks = Counter(tuple(w[i : i + 18]) for w, u in zip(words, use, strict=True) if u for i in range(0, len(w) - 17, 18))
    every = Counter(tuple(w[i : i + 18]) for w, u in zip(words, use, strict=True) if u for i in range(len(w) - 17))
    for k, w in enumerate(words):
        want = [i for i in range(len(w) - 17) if use[k] and blocks[tuple(w[i : i + 18])] and every[tuple(w[i : i + 18])] > 1]
        assert hit.get(k, []) == want


def test_repeats_of_a_whole_table(spark, data):
    """Whatever a document loses repeats word for word elsewhere, and nothing that does is left."""
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()]
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.op9_repeats(spark, data).collect()}
    assert [rows[k] for k in sorted(rows)] == without_repeats(texts)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    rows = repeats.remove_repeats(docs(spark, [None, ""])).collect()
    assert [(r["n_words"], r["text"]) for r in rows] == [(0, ""), (0, "")]


def test_packing_of_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**32, 1000).astype(np.uint32))[:, None]
    assert (repeats.unpacked_keys(repeats.packed_keys(keys), np.uint32) == keys).all()
    wide = np.random.default_rng(2).integers(0, 2**64, (1000, 2), dtype=np.uint64)
    assert (repeats.unpacked_keys(repeats.packed_keys(wide), np.uint64) == wide).all()


def test_collisions_remove_nothing(monkeypatch):
    """Where all windows have the same hash, all are candidates, but only windows of the same words are removed."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "window_hashes", lambda words, size: np.zeros(max(0, len(words) - size + 1), dtype=np.uint64))
    texts = repeat_texts()
    ids = [pa.array(range(len(texts)), pa.int64())] * 2

    def found(batch, size, anchored):
        table = pa.Table.from_batches(list(repeats.packer(size, 1, anchored)(iter([batch]))))
        hits = repeats.matcher(anchored)(table)
        each = pa.concat_tables([repeats.unpack(hits.filter(pa.compute.equal(hits.column("batch"), b))) for b in set(hits.column("batch").to_pylist())])
        return dict(zip(each.column("k1").to_pylist(), each.column("places").to_pylist(), strict=True))

    anchors = found(pa.RecordBatch.from_arrays([*ids, pa.array(texts)], ["k1", "k2", "text"]), repeats.BLOCK, True)
    use = sorted(anchors)
    assert use == [k for k, t in enumerate(texts) if len((t or "").split()) >= repeats.WINDOW]
    some = pa.RecordBatch.from_arrays([pa.array(use, pa.int64())] * 2 + [pa.array([texts[k] for k in use]), pa.array([anchors[k] for k in use])], ["k1", "k2", "text", "places"])
    windows = found(some, repeats.WINDOW, False)
    out = next(iter(repeats.strip(iter([pa.RecordBatch.from_arrays([ids[0], pa.array(texts), pa.array([windows.get(k) for k in range(len(texts))], pa.binary())], ["id", "text", "places"])]))))
    assert out.column("n_removed").to_pylist() == [n for _, n, _ in without_repeats(texts)]


def test_rows_with_nulls_on_either_side(spark):
    """A row's keys tell (null, text) and (text, null) apart."""
    passage = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, passage), (passage, None), (None, None), ("a", "x " + passage)], "doc_id string, text string")
    rows = repeats.remove_repeats(df).collect()
    assert sorted((r["doc_id"] or "", r["n_words"], r["n_removed"]) for r in rows) == [("", 0, 0), ("", 40, 40), ("a", 41, 40), (passage, 0, 0)]
    assert len(simhash.deduplicated(df).collect()) == 2
    kept = exact.deduplicated(df).collect()
    assert len(kept) == 3 and (None, passage) in {tuple(r) for r in kept}


def test_hub_that_is_like_none_hides_no_pairs(spark):
    """Twenty pairs of equal texts, all under the keys of a hub that is like none of them."""
    scheme = simhash.Scheme(words=5, lanes=4, distance=44, segments=12, similarity=0.8)
    # fingerprints that differ in two bits or more of the first segment only
    rows = [(k, k, 0, k, 2 * k + k.bit_count() % 2, 0, 0, 0, 1) for k in range(41)]
    said = [f"word{(k + 1) // 2} " * 3 for k in range(41)]
    rows = spark.createDataFrame(rows, "id long, k1 long, k2 long, node long, f0 long, f1 long, f2 long, f3 long, size long")
    texts = spark.createDataFrame([(k, 0, t) for k, t in enumerate(said)], "k1 long, k2 long, text string")
    got = {r["node"]: r["least"]["id"] for r in simhash.grouped(rows, scheme, texts).collect()}
    assert got == {k: said.index(t) for k, t in enumerate(said)}


def test_repeated_passages_leave_wide_fingerprints(spark):
    """A text and the same with its first 60 words six times more share 0.97 of their shingles: they must be candidates."""
    text = prose(random.Random(11), 300, 5000)
    longer = " ".join([text, *[" ".join(text.split()[:60])] * 6])
    a, b = ([r[f"f{k}"] % 2**64 for k in range(4)] for r in simhash.fingerprints(docs(spark, [text, longer]), scheme=simhash.WIDE).collect())
    assert sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= 23


def test_equal_fingerprints_of_different_texts(spark):
    """Texts with one fingerprint (a line a hundred times, then own words) and different shingles aren't one node; texts with the same shingles are."""
    rng = random.Random(12)
    line = "a line of nine words that comes very often "
    one, other = (line * 100 + prose(rng, 60, 5000) for _ in range(2))
    node = {r["id"]: r["node"] for r in simhash.fingerprints(docs(spark, [one, other, one.upper(), None, ""]), scheme=simhash.WIDE).collect()}
    assert node[0] == node[2] != node[1] and node[3] == node[4]
    made = simhash.fingerprints_of([one, other, one.upper(), ""], 5, 4, True)
    assert made.shape == (4, 6) and made[3, 5] == 0 and made[0, 4] == made[2, 4] != made[1, 4]



@pytest.mark.parametrize("size", [60, 200, 1000])
def test_wide_recall_by_similarity(size):
    """Of pairs of shingle sets at a similarity of 0.8 to 0.95, all of them known, the segments and the distance find nearly all."""
    rng, scheme = np.random.default_rng(size), simhash.WIDE
    for similarity in (0.8, 0.82, 0.85, 0.9, 0.95):
        same = int(np.ceil(2 * similarity / (1 + similarity) * size))
        whole = [rng.integers(0, 2**64, 2 * size - same, dtype=np.uint64) for _ in range(400)]
        bits = []
        for some in ([w[:size] for w in whole], [w[size - same :] for w in whole]):
            flat, starts = np.concatenate(some), np.arange(400) * size
            bits.append(np.concatenate([2 * simhash.bit_counts(simhash.lanes_of(flat, k), starts) > size for k in range(scheme.lanes)], axis=1))
        apart = bits[0] != bits[1]
        met = np.any([(apart[:, scheme.order(cut).reshape(scheme.segments, -1)].sum(axis=2) <= 1).any(axis=1) for cut in range(scheme.cuts)], axis=0)
        assert (met & (apart.sum(axis=1) <= scheme.distance)).mean() >= 0.99


def test_narrow_tables_are_kept_in_few_files(spark):
    """However many tasks made them; a group's links and rounds are a few rows each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
        found = C.cut_narrow(simhash.components(edges))
        assert found.rdd.getNumPartitions() == 1 and {tuple(r) for r in found.collect()} == {(k, 0) for k in range(31)}
        many = C.cut_narrow(spark.range(0, 3 * C.FILE_ROWS, 1, 40))
        assert many.rdd.getNumPartitions() == 3 and many.agg(F.sum("id")).first()[0] == sum(range(3 * C.FILE_ROWS))
        assert C.cut_narrow(spark.range(0)).collect() == []
        assert simhash.components(edges).rdd.getNumPartitions() <= 41
        assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held  # nothing stays cached
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
