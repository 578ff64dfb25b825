"""Language, mixing, packing, sharding and the pipeline."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import difference
from pyspark.sql import functions as F

from cairn.llm import exact, language, mixing, packing, registry, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target double, epoch int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3.0, 4) for r in rows], SCHEMA).repartition(3)


def folder(df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def real(sf):
    return duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet' ORDER BY doc_id").df()


def test_registered_sql(spark, data):
    for name, sql in registry.oracle_sql().items():
        assert not difference(spark, name, registry.queries()[name], sql, data)


# --- language ----------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, data):
    found = language.op6_language(spark, data).toPandas().merge(real(data)[["doc_id", "lang"]], on="doc_id")
    assert len(found) == 200 and found["score"].between(0, 1).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]).all()
    out = found[found["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() >= 0.97


def counted(text):
    """N-grams of one text the plain way."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = "\1" + word + "\1"
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def gram(number):
    points = [(number >> s) & 0x1FFFFF for s in (42, 21, 0)]
    return points


@pytest.mark.parametrize("texts", [["Ab, ab! a", "", "ÜBER straße", "x1y"], ["日本語 text", "a"], ["İ"], ["..."]])
def test_gram_counts(texts):
    owner, grams, count = language.gram_counts(texts)
    for k, text in enumerate(texts):
        mine = sorted((tuple(gram(int(g))), int(n)) for o, g, n in zip(owner, grams, count, strict=True) if o == k)
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        want = sorted((tuple([0] * (3 - len(g)) + [ord(c) for c in g]), n) for g, n in counted(letters).items())
        assert mine == want


def test_very_many_letters():
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    texts = ["".join(letters[k::2000]) for k in range(2000)]
    owner, grams, count = language.gram_counts(texts)
    for k in (0, 999, 1000, 1999):
        alone = language.gram_counts([texts[k]])
        assert (grams[owner == k] == alone[1]).all() and (count[owner == k] == alone[2]).all()


def test_language_edges(spark, data):
    profiles = language.learn(spark.read.parquet(f"{data}/documents.parquet"))
    assert sorted(profiles) == ["de", "en", "es", "fr"] and all(len(p) <= language.PROFILE_GRAMS for p in profiles.values())
    df = docs(spark, [(1, None, "en", "s"), (2, "", None, "s"), (3, "123 ... !", "en", None), (4, "the thing", "en", "s"), (4, "the thing", "en", "s"), (None, "ß" * 100_000, "de", "s")])
    rows = language.identify(df, profiles).collect()
    assert len(rows) == 6
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in rows}
    assert got[1, None] == got[2, ""] == got[3, "123 ... !"] == ("und", 0.0) and got[4, "the thing"][0] == "en"
    assert {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}
    assert language.learn(docs(spark, [])) == {} and language.identify(docs(spark, []), profiles).count() == 0
    assert language.learn(df.filter("lang = 'de'")) == {}


def test_sample_is_bounded(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    few = language.learn(df, sample_docs=3)
    assert few == language.learn(df.repartition(7), sample_docs=3) and set(few) == {"de", "en", "es", "fr"}


def identified(texts, profiles, most=300):
    """Language and score the plain way: n-grams by frequency, then number; out-of-place distance, the worst where a profile hasn't one."""
    worst = max(map(len, profiles.values()))
    out = []
    for text in texts:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        counts = Counter({sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))): n for g, n in counted(letters).items()})
        ranked = sorted(counts, key=lambda g: (-counts[g], g))[:most]
        if not ranked:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(min(abs(own.index(g) - k), worst) if g in own else worst for k, g in enumerate(ranked)) for lang, own in sorted(profiles.items())}
        best = min(far, key=far.get)
        out.append((best, 1 - far[best] / (len(ranked) * worst)))
    return out


def test_predictions_against_brute_force(spark, data):
    """Ranks, ties, distances and scores, on real texts and on ones where languages are as near as each other."""
    docs_ = spark.read.parquet(f"{data}/documents.parquet")
    profiles = language.learn(docs_, profile_grams=60)
    texts = [r["text"] for r in docs_.select("text").collect()][:60] + ["", "1 2", "aaa aaa", "zzz qqq", "ab ba ab ba", "x"]
    profiles |= {"twin": profiles["de"], "empty-ish": profiles["en"][:1]}
    names, scores = language.predictor(profiles)(texts)
    want = identified(texts, profiles)
    assert names == [n for n, _ in want] and np.allclose(scores, [s for _, s in want])
    assert "twin" not in names


# --- mixing ------------------------------------------------------------------------------------------------


def water_fill(sizes):
    """Targets by sharing the excess again and again."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(keys)
    while free:
        level = (total - sum(out.values())) / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 2 * sizes[k]]
        if not over:
            return out | {k: weight[k] * level for k in free}
        for k in over:
            out[k] = 2.0 * sizes[k]
            free.discard(k)
    return out


def test_mix_meets_its_targets(spark, data):
    found = mixing.op4_mixing(spark, data).toPandas().merge(real(data)[["doc_id", "source", "text"]], on="doc_id")
    assert (found["size"] == [len(WORD.findall(t)) for t in found["text"]]).all() and (found["taken"] <= 2 * found["size"]).all()
    by = found.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all()
    want = water_fill(by["size"].to_dict())
    assert np.allclose(by["target"], [want[s] for s in by.index]) and (abs(by["taken"] - by["target"]) <= mixing.BLOCK_WORDS).all()
    again = mixing.op4_mixing(spark, data).toPandas()
    key = ["doc_id", "taken"]
    assert again[key].sort_values("doc_id").reset_index(drop=True).equals(found[key].sort_values("doc_id").reset_index(drop=True))


def test_mix_of_odd_rows(spark):
    rows = [(1, "w " * 5000, "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, "x y", "en", None), (4, "x y", "en", None), (None, "z " * 300, "en", "b"), (6, " ", "en", "empty")]
    plan = mixing.mix(docs(spark, rows))
    got = mixing.taken(plan).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["__size"]).all()
    want = water_fill({"a": 5000, "b": 300, "empty": 0, None: 4})
    assert sorted({round(t, 6) for t in got["target"]}) == sorted({round(t, 6) for t in want.values()})
    slots = plan.slots.toPandas()
    places = slots["shard"] * mixing.SHARD_SLOTS + slots["slot"]
    assert sorted(places) == list(range(len(slots)))
    assert slots.groupby(["__key", "epoch"])["block"].is_unique.all() if hasattr(slots.groupby(["__key", "epoch"])["block"], "is_unique") else not slots.duplicated(["__key", "epoch", "block"]).any()
    empty = mixing.mix(docs(spark, []))
    assert mixing.taken(empty).count() == 0 and empty.slots.count() == 0
    assert mixing.taken(mixing.mix(docs(spark, [(1, None, "en", "a")]))).collect()[0]["taken"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.seeds_of(3, F.lit("x"))).alias("to")).collect()
    assert sorted(r["to"] for r in rows) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef([r["id"] for r in rows], [r["to"] for r in rows])[0, 1]) < 0.25


def test_shards_have_multinomial_counts(spark, data):
    slots = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"), block=8).slots.toPandas()
    share = slots.groupby("__key").size() / len(slots)
    whole = slots[slots["shard"] < slots["shard"].max()].groupby(["shard", "__key"]).size().unstack(fill_value=0)
    z = (whole - mixing.SHARD_SLOTS * share) / np.sqrt(mixing.SHARD_SLOTS * share * (1 - share))
    assert abs(z.to_numpy()).max() < 5 and z.to_numpy().std() > 0.3


def test_counts_of_shards(spark, data):
    """Every shard but the last is full, and the sources' slots are those of their targets."""
    plan = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))
    counts = mixing.shard_counts(plan).toPandas()
    full = counts.groupby("shard")["slots"].sum().sort_index()
    assert (full.iloc[:-1] == mixing.SHARD_SLOTS).all() and 0 < full.iloc[-1] <= mixing.SHARD_SLOTS
    targets = {r["__key"]: r["target"] for r in plan.sources.collect()}
    assert all(abs(n * mixing.BLOCK_WORDS - targets[k]) <= 3 * mixing.BLOCK_WORDS for k, n in counts.groupby("__key")["slots"].sum().items())


def test_the_driver_gets_no_slots(spark, data):
    """A few hundred rows become all slots and parts: no estimate of those rows may have them broadcast."""
    out = mixing.mixed_documents(spark.read.parquet(f"{data}/documents.parquet"))
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__key" in plan and "BroadcastHashJoin [__key" not in plan


def test_mixed_documents_are_what_is_taken(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "\n".join(f"w{k}_{i}" for i in range(rng.integers(0, 400))), "en", "abc"[k % 3]) for k in range(30)]
    df = docs(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.toPandas()
    assert (got["n_chars"] == got["text"].str.len()).all()
    words = got.groupby("doc_id")["text"].agg(lambda t: sum(len(x.split()) for x in t)).to_dict()
    taken = {r["__id"]: r["taken"] for r in mixing.taken(mixing.mix(df, row_col=None)).collect()}
    assert {k: v for k, v in taken.items() if v} == words
    text = dict((r[0], r[1].split()) for r in rows)
    for doc, own in zip(got["doc_id"], got["text"], strict=True):
        at = [text[doc].index(w) for w in own.split()]
        assert at == sorted(at)


# --- packing -----------------------------------------------------------------------------------------------


def check_packing(frame, capacity):
    frame = frame.sort_values(["sequence_id", "offset"])
    sizes = frame.groupby("sequence_id")["length"]
    assert (sizes.sum() <= capacity).all() and (sizes.cumsum() - frame["length"] == frame["offset"]).all()


def test_packing_of_documents(spark, data):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = packing.op5_packing(spark, data).toPandas()
    check_packing(found, packing.CAPACITY)
    want = set()
    for doc, text in zip(real(data)["doc_id"], real(data)["text"], strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
    assert set(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 2048) + 1


def best_fit(lengths, capacity):
    """Best fit, longest first, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_ids_are_those_of_the_named_file():
    """Over every whole text of the largest table that comes with the tests."""
    import public_tokenizers
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(*packing.default_tokenizer()).encode_ordinary
    texts = real("/root/testdata/sf0.1")["text"].tolist() + ["a" * 300_000, " \n" * 10_000, "\u00e9\U0001f600" * 1000]
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        assert [e.ids for e in named.encode_batch(some, add_special_tokens=False)] == [encode(t) for t in some]



@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 40))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
    used, seen = Counter(), Counter()
    for length, low, high, first, offset in packing.plan(dict(Counter(lengths)), capacity):
        for r in range(low, high):
            used[first + r - low] += length
            seen[length, r] += 1
            assert offset + length <= capacity
    assert sum(seen.values()) == len(lengths) and set(seen.values()) == {1}
    assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity)


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKS", 4)
    rows = [(k, "word " * (k % 9), "en", "s") for k in range(200)] + [(5, None, "en", "s"), (5, None, "en", "s"), (None, "", "en", "s"), (7, "long " * 3000, "en", "s")]
    packed = packing.pack_documents(docs(spark, rows), capacity=16, keep_ids=True)
    frame = packed.toPandas()
    check_packing(frame, 16)
    assert frame[frame["start"] == 0].shape[0] == len(rows)
    whole = packing.assemble(packed).toPandas()
    assert whole["ids"].map(len).sum() == frame["length"].sum() and whole["ids"].map(len).max() <= 16
    assert packing.pack_documents(docs(spark, [])).count() == 0


# --- sharding ----------------------------------------------------------------------------------------------


def test_interleaving(spark, data):
    found = shards.op8_shards(spark, data).toPandas().merge(real(data)[["doc_id", "text"]], on="doc_id")
    assert (found["size"] == [len(t.encode()) + 1 for t in found["text"]]).all()
    assert (found["text_crc32"] == [zlib.crc32(t.encode()) for t in found["text"]]).all()
    counts = found.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 8
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard")["slot"])
    mixture = found.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (mixture.max() - mixture.min() <= 2).all()


def test_sharding_of_odd_rows(spark):
    rows = [(k, "é" * k, "en", None if k % 2 else "a") for k in range(21)] + [(3, None, "en", None), (3, None, "en", None), (None, "x", "en", "b")]
    got = shards.interleave(docs(spark, rows), shards=5).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 24 and sizes.max() - sizes.min() <= 1 and (got.groupby("shard")["slot"].max() + 1 == sizes).all()
    assert got[(got["doc_id"] == 3) & (got["size"] == 1)]["text_crc32"].tolist() == [0, 0]
    again = shards.interleave(docs(spark, rows).repartition(7), shards=5).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    assert again[key].sort_values(key).reset_index(drop=True).equals(got[key].sort_values(key).reset_index(drop=True))
    assert shards.interleave(docs(spark, [])).count() == 0
    assert shards.interleave(docs(spark, rows[:2]), shards=5)["shard", "slot"].count() == 2


# --- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    texts = real(data)
    df = spark.read.parquet(f"{data}/documents.parquet")
    more = docs(spark, [(10_000, None, None, "s"), (10_001, "123 456", "en", "s"), (10_002, texts["text"][0] + " ", "en", "zz")]).select(df.columns)
    now = df.unionByName(more)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data)
        assert now.columns == df.columns
        now = spark.createDataFrame(now.toPandas(), df.schema)
        kept[name] = now.toPandas()
    assert set(texts["doc_id"]) | {10_002} == set(kept["language"]["doc_id"])
    groups = exact.exact_groups(df.unionByName(more).filter("doc_id < 10000 or doc_id = 10002")).filter("kept").select("doc_id").toPandas()
    assert set(groups["doc_id"]) == set(kept["exact_dedup"]["doc_id"]) and 10_002 in set(groups["doc_id"])
    assert set(kept["simhash_dedup"]["doc_id"]) <= set(kept["exact_dedup"]["doc_id"])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, data).toPandas()
    check_packing(packed, packing.CAPACITY)
    words = kept["mixing"]["text"].str.split().map(len).sum()
    assert abs(words / kept["simhash_dedup"]["text"].str.split().map(len).sum() - 1.5) < 0.02
    assert set(packed["doc_id"]) == set(kept["mixing"]["doc_id"])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    path = folder(docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars"), tmp_path)
    assert corpus_pipeline.run(spark, path).count() == 0


def test_pandas_is_not_needed_for_native_operators(spark, data):
    """Native operators run no Python on executors."""
    for name in ("op1_secrets", "op4_mixing", "op7_exact", "op8_shards"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert isinstance(real(data), pd.DataFrame)
