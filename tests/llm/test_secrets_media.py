"""Secret scans, media columns and tool calls against plain Python."""

import hashlib
import json
import random
import re
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import common, media, secrets, toolcalls

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string"


def docs(spark, texts, ids=None):
    rows = [(ids[k] if ids else k, t, "en", "s", None if t is None else len(t), "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def folder(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def base(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


TRICKY = [
    None, "", "nothing", "Password = 'abcdef' token:short secret: token: abcdefgh", "sécrét SECRET=ünder token=abcdef_./+=-x", "api_key=APIKEY:abcdefg",
    "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 15 + " AKIAB", "0" * 24 + "g" + "a" * 23, "😀 token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" 😀 passwd:123456", "passwordpassword==abcdef", "apikey" * 3000 + "=" + "z9" * 5000,
]


def test_base_spans(spark, tmp_path):
    rows = secrets.op1_secrets(spark, folder(spark, docs(spark, [*TRICKY, TRICKY[3]], [*range(len(TRICKY)), 3]), tmp_path)).collect()
    assert len(rows) == len(TRICKY) + 1
    for r in rows:
        want = base(TRICKY[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == want
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


ALPHABETS = {name: alphabet for name, _, alphabet in secrets.ENCODINGS if name != "mixed"}
WORDS = "account active archive backup batch buffer builder cache channel client cluster config context counter current database default deploy device driver encode engine error event factory field filter format global handler header image index input instance job key label latest layer level library limit list loader local log manager map memory message metadata method model module name network node object offset option order output package parser path pattern payload plan point policy pool port process project proxy query queue range record reference region registry release remote request resource result route schema score script search section segment server service session shard size snapshot socket source stage state storage stream string system table target task template test thread time timeout tool topic trace train transform tree type update user utils value vector version view widget window worker".split()


def secrets_of(n, alphabet, rng, count):
    out = []
    while len(out) < count:
        key = "".join(rng.choices(alphabet, k=n))
        if re.search("[0-9]", key) and re.search("[A-Za-z]", key):
            out.append(key)
    return out


def names(rng, count):
    """Identifiers, paths, slugs, dates and versions of code and prose."""
    out = []
    for k in range(count):
        own = [rng.choice(WORDS) for _ in range(rng.randrange(3, 9))]
        number = str(rng.randrange(1, 3000))
        out.append(
            (
                "".join(w.capitalize() for w in own) + number,
                "_".join(own) + "_" + number,
                "/".join(own) + "/v" + number,
                f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}-" + "-".join(own),
                own[0] + "".join(w.capitalize() for w in own[1:]) + number,
                "".join(own) + number,
                "-".join(own).upper() + "-" + number,
            )[k % 7]
        )
    return [x for x in out if len(x) >= 16]


def found_of(spark, texts):
    rows, spans = secrets.scan(docs(spark, texts))
    ids = {r["row"]: r["id"] for r in rows.collect()}
    return [(ids[s["row"]], s["value"]) for s in spans.filter("kind = 'random'").collect()]


@pytest.mark.parametrize("n", [16, 24, 40, 64, 200, 1000, 1500, 3000, 20_000])
def test_battery_finds_random_tokens_of_any_length(spark, n):
    """A tenth of the tokens are random: nine of ten are found, whatever the alphabet, and hardly any of the others."""
    rng = random.Random(n)
    count = 200 if n < 24 else 40 if n <= 200 else 12
    # hex is a pattern of its own; 16 characters of a small alphabet hold too little to tell them apart
    use = [a for a in ALPHABETS if a not in ("hex", "HEX", "base32")] if n >= 40 else ["base62", "base64", "base64url"]
    keys = [k for a in use for k in secrets_of(n, ALPHABETS[a], rng, count)]
    plain = names(rng, 7 * len(keys))
    found = found_of(spark, [f"see {k} there" for k in [*keys, *plain]])
    hits = {i for i, v in found if i < len(keys) and v == keys[i]}
    false = [v for i, v in found if i >= len(keys)]
    assert len(hits) >= 0.9 * len(keys)
    assert len(false) <= max(1, 0.01 * len(found))


def test_a_million_characters(spark):
    rng = random.Random(1)
    keys = [secrets_of(1_000_000, ALPHABETS[a], rng, 1)[0] for a in ("base62", "base64")]
    assert {i for i, _ in found_of(spark, [f"a {k} b" for k in keys] + [("word1" * 200_000)])} == {0, 1}


def test_code_and_prose_have_no_secrets(spark):
    rng = random.Random(8)
    plain = names(rng, 4000) + ["a1" * 20, "0123456789abcdefghijklmnop", "x86_64-linux-gnu-toolchain-build", "abcdefghijklmnopqrstuvwxyz0123456789", "AAAAAAAAAAAAAAAAAAAA1"]
    assert len(found_of(spark, [f"see {x} there" for x in plain])) <= 2


def test_random_spans_leave_base_ones(spark):
    text = "token=Zx81kQpL0vB7nM3cTr9sWy2eUa6D and Zx81kQpL0vB7nM3cTr9sWy2eUa6D"
    _, spans = secrets.scan(docs(spark, [text]))
    got = sorted((s["kind"], s["start"], s["end"]) for s in spans.collect())
    assert ("assign", 0, 34) in got and all(s >= 34 for k, s, _ in got if k == "random")


def test_secrets_of_nothing(spark):
    rows, spans = secrets.scan(docs(spark, []))
    assert rows.count() == 0 and spans.count() == 0


# --- media ---------------------------------------------------------------------------------------------


def test_png_round_trip():
    for text in (None, "", "a", "é" * 96, "x" * 193, "line\n" * 5000):
        samples = media.payload(text)
        assert len(samples) % media.WIDTH == 0 and samples.rstrip(b" ") == (text or "").encode().rstrip(b" ")
        data = media.to_png(samples)
        assert media.from_png(data).tobytes() == samples and data == media.to_png(samples)
        assert media.png_header(data[: media.HEADER_BYTES]) == (media.WIDTH, len(samples) // media.WIDTH, 8)
        with pytest.raises(ValueError):
            media.from_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])


def test_media_columns(spark, tmp_path):
    texts = [None, "", "a", "a", "b" * 192, "ü" * 100, "long " * 20000, "a"]
    rows = media.op3_media(spark, folder(spark, docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 2]), tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-16:])
        assert r["width"] * r["height"] == len(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_shards_are_tar_files(spark, tmp_path):
    root = str(tmp_path / "shards")
    found = media.write_shards(docs(spark, ["a", "b", "a", "c" * 1000]).repartition(2), root, shard_bytes=2000).collect()
    assert len(found) == 3
    for r in found:
        with tarfile.open(f"{root}/{r['shard']}") as tar:
            entry = tar.getmember(f"{r['digest'].hex()}.png")
            assert entry.offset_data == r["offset"] and entry.size == r["length"]
            assert hashlib.sha256(tar.extractfile(entry).read()).digest() == r["media_sha256"]
    assert media.with_media(docs(spark, []), str(tmp_path / "none")).count() == 0


# --- tool calls ------------------------------------------------------------------------------------------

CALLS = "uid long, id string, after string, at long, name string, arguments string"
RESULTS = "uid long, id string, at long, content string"
TOOLS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "mode": {"enum": ["x", "y"]}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "additionalProperties": False}}


def test_schema_faults():
    bad = lambda v: toolcalls.faults(v, TOOLS["add"])
    assert bad({"a": 1, "b": None}) == [] and bad({"a": 1, "b": 2.5, "mode": "x", "tags": ["ok"]}) == []
    assert bad({"a": True, "b": 1}) == ["$.a: type"] and bad({"a": -1, "b": 1}) == ["$.a: minimum"]
    assert bad({"a": 1}) == ["$.b: required"] and bad([]) == ["$: type"]
    assert bad({"a": 1, "b": 1, "c": 1, "mode": "z", "tags": ["long", 3]}) == ["$.c: unknown", "$.mode: enum", "$.tags[0]: maxLength", "$.tags[1]: type"]


def test_linking(spark):
    calls = [
        (1, "a", None, 0, "add", '{"b": 2, "a": 1}'), (2, "b", "a", 2, "add", '{"a": "é"}'), (3, "c", "b", 4, "gone", "{}"), (4, "a", None, 9, "add", "no json"),
        (5, None, None, 5, "add", None), (6, "p", "q", 1, "add", "{}"), (7, "q", "p", 1, "add", "{}"),
    ]
    results = [(11, "a", 1, "three"), (12, "b", 3, None), (13, "z", 3, "lost"), (14, "a", 7, "again")]
    rows = {r["uid"]: r for r in toolcalls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()}
    assert len(rows) == 11
    assert {u: r["link"] for u, r in rows.items()} == {1: "linked", 2: "linked", 3: "no result", 4: "duplicate", 5: "no result", 6: "no result", 7: "no result", 11: "linked", 12: "linked", 13: "no call", 14: "duplicate"}
    assert {u: rows[u]["depth"] for u in (1, 11, 2, 12, 3, 13)} == {1: 0, 11: 1, 2: 2, 12: 3, 3: 4, 13: 0}
    assert rows[6]["depth"] is None and rows[7]["depth"] is None
    assert rows[1]["valid"] and rows[1]["json"] == '{"function":{"arguments":{"a":1,"b":2},"name":"add"},"id":"a","type":"function"}'
    assert rows[2]["errors"] == ["$.b: required", "$.a: type"] and not rows[12]["valid"]
    assert rows[3]["errors"] == ["$: unknown tool"] and rows[4]["errors"] == ["$: no JSON"] and rows[5]["errors"] == ["$: no JSON"]
    assert json.loads(rows[11]["json"]) == {"content": "three", "role": "tool", "tool_call_id": "a"}


def longest(parents):
    """Depths the plain way: None in a cycle and behind one."""
    out, left = {}, dict(parents)
    while ready := [u for u, own in left.items() if all(p in out for p in own)]:
        for u in ready:
            out[u] = 1 + max((out[p] for p in left[u]), default=-1)
        left = {u: own for u, own in left.items() if u not in ready}
    return out | dict.fromkeys(left)


def graphs():
    rng = random.Random(9)
    yield {u: [u - 1] if u else [] for u in range(300)}
    # calls in parallel whose results the next call waits for
    yield {u: [] if u == 0 else [u - u % 5] if u % 5 in (1, 2, 3) else [u - 1, u - 2, u - 3] if u % 5 == 4 else [u - 1] for u in range(120)}
    yield {u: sorted({rng.randrange(u) for _ in range(rng.choice((0, 1, 1, 2)))}) if u else [] for u in range(25)}
    yield {0: [], 1: [0, 3], 2: [1], 3: [2], 4: [3, 0], 5: [0], 6: [6], 7: [5, 6], 8: [5]}


@pytest.mark.parametrize(("graph", "scope"), [(0, 1 << 20), (1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (1, 0), (2, 0), (3, 0)])
def test_topological_order(spark, monkeypatch, graph, scope):
    """In tasks and by rounds alike; several graphs of shifted numbers lie in scopes of their own."""
    monkeypatch.setattr(toolcalls, "SCOPE", scope)
    parents = list(graphs())[graph]
    copies = 1 if scope == 0 else 5
    rows = [(f"s{k}", u + 1000 * k, p if p is None else p + 1000 * k) for k in range(copies) for u, own in parents.items() for p in [None, *own]]
    got = {r["uid"]: r["depth"] for r in toolcalls.ordered(spark.createDataFrame(rows, "scope string, uid long, parent long")).collect()}
    assert got == {u + 1000 * k: d for k in range(copies) for u, d in longest(parents).items()}


def test_many_scopes_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "TOGETHER", 7)
    rows = [(f"s{k}", 100 * k + u, p) for k in range(60) for u in range(k % 9 + 1) for p in ([None] if u == 0 else [None, 100 * k + u - 1])]
    df = spark.createDataFrame(rows, "scope string, uid long, parent long")
    got = {r["uid"]: r["depth"] for r in toolcalls.ordered(df).collect()}
    assert got == {100 * k + u: u for k in range(60) for u in range(k % 9 + 1)}


def test_waiting_for_several_results(spark):
    calls = [("s", 1, "a", [], 0, "add", "{}"), ("s", 2, "b", [], 0, "add", "{}"), ("s", 3, "c", ["a", "b", "gone", None, "a"], 2, "add", "{}"), ("t", 4, "a", None, 0, "add", "{}"), (None, 5, "c", ["a"], 0, "add", "{}")]
    results = [("s", 11, "a", 1, "x"), ("s", 12, "c", 3, "y"), ("t", 13, "b", 1, "z")]
    calls = spark.createDataFrame(calls, "scope string, uid long, id string, after array<string>, at long, name string, arguments string")
    results = spark.createDataFrame(results, "scope string, uid long, id string, at long, content string").withColumn("key", F.lit(1)).withColumn("kind", F.lit("k"))
    got = {r["uid"]: (r["link"], r["depth"]) for r in toolcalls.link_calls(calls, results, TOOLS).collect()}
    assert got == {1: ("linked", 0), 11: ("linked", 1), 2: ("no result", 0), 3: ("linked", 2), 12: ("linked", 3), 4: ("no result", 0), 13: ("no call", 0), 5: ("no result", 0)}


def test_arguments_that_are_no_json(spark):
    said = ['{"a": NaN, "b": 1}', '{"a": 1e999, "b": 1}', '{"a": "\\ud800"}', '{"\\udc00": 1}', "[" * 100_000, "9" * 10_000, "", None, '{"a": 1, "b": 1}', '{"a": 1, "a": 2, "b": "\\ud83d\\ude00"}']
    calls = spark.createDataFrame([(k, f"c{k}", None, 0, "add", a) for k, a in enumerate(said)], CALLS)
    rows = {r["uid"]: r for r in toolcalls.link_calls(calls, spark.createDataFrame([], RESULTS), TOOLS).collect()}
    assert [rows[k]["errors"] for k in range(8)] == [["$: no JSON"]] * 8 and rows[8]["valid"] and rows[9]["errors"] == ["$.b: type"]
    for k, a in enumerate(said[:8]):
        assert json.loads(rows[k]["json"])["function"]["arguments"] == a


def test_conversations_with_gaps_match_their_sql(spark, tmp_path):
    from compare import difference

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "developer", None]), rng.choice(["x", "", "y" * 401, None])) for c in range(150) for t in range(9) if rng.random() < 0.85]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    import glob
    import shutil

    for name in ("conversations", "documents"):
        shutil.copy(glob.glob(f"{tmp_path}/t/*.parquet")[0], f"{tmp_path}/{name}.parquet")
    assert not difference(spark, "op2", toolcalls.op2_toolcalls, toolcalls.ORACLE, str(tmp_path))


def test_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "r"), (1, 3, "user", "v"), (5, 0, None, "n"), (5, 1, "user", "u"), (5, 2, "tool", "t"), (5, 3, "developer", None), (5, 4, "user", "u"), (2, 0, "user", None), (2, 1, "assistant", None), (None, 0, "user", "w"), (3, None, "user", "x"), (4, 5, "assistant", "alone"), (1, 1, "user", "u")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = toolcalls.op2_toolcalls(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"], r["link"]): r for r in got}
    assert [by[1, t, k]["depth"] for t, k in ((0, "no result"), (1, "linked"), (2, "linked"), (3, "no result"))] == [0, 1, 2, 3]
    assert by[5, 0, "unlinked"]["json"] == '{"content":"n","role":null}' and not by[5, 3, "unlinked"]["valid"]
    assert by[5, 2, "linked"]["depth"] == 1 and by[5, 4, "no result"]["depth"] == 0
    assert (1, 1, "duplicate") in by and by[4, 5, "no call"]["depth"] == 0 and not by[2, 0, "linked"]["valid"]
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    empty.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert toolcalls.op2_toolcalls(spark, str(tmp_path)).count() == 0
