"""Corpus operators against brute force, exact round trips and held-out accuracy, on small tables.

Each table has nulls, empty and very long texts, ties, repeated rows and extra
columns whose names clash with what operators use inside.
"""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import struct
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import chat, exact_dedup, language_id, mixing, ngram_join, quality, sentencepiece_codec, sharding, url_filter, warc
from lakeweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, shard int, rank int, size string"
VOCABULARY = {
    "en": "the and of to in that was for with his they from have this not but which one were all there would their we him been has when who".split(),
    "fr": "le la les des une dans que pour qui par sur est avec plus son pas mais nous être tout même ces leur fait été".split(),
}


def make_docs(spark, seed=1, n=60):
    r = random.Random(seed)
    rows, texts = [], []
    for k in range(n):
        lang = r.choice(["en", "fr"])
        words = [r.choice(VOCABULARY[lang]) + (str(r.randrange(50)) if r.random() < 0.4 else "") for _ in range(r.choice([3, 20, 60, 120]))]
        if texts and r.random() < 0.4:  # a near copy
            lang, copied = r.choice(texts)
            words = copied.split()
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = "changed" + str(r.randrange(1000))
        text = " ".join(words)
        texts.append((lang, text))
        rows.append((k, text, lang, r.choice(["a", "b", "é", "Z", None])))
    texts = [t for _, t in texts]
    rows += [(n, None, "en", "a"), (n + 1, "", "fr", None), (n + 2, " \t\n", None, "b"), (n + 3, texts[0], "en", "a"), (n + 4, texts[0].replace(" ", " \n "), "en", "b"), (n + 4, texts[0].replace(" ", " \n "), "en", "b")]
    rows += [(n + 5, "One two three", "en", "a"), (n + 6, "ONE TWO THREE", "en", "a"), (None, texts[1], "en", "b"), (n + 7, " ".join(f"w{k}" for k in range(20_000)), "en", "a"), (n + 8, "12345 !!!", "en", "Z")]
    return spark.createDataFrame([(i, t, lang, s, None, "x", 1, 2, 3, "y") for i, t, lang, s in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup


@pytest.mark.parametrize("fan_in", [2, 4])
def test_exact_dedup(spark, fan_in):
    docs, rows = make_docs(spark)
    rows += [(None, f"null {k}", "en", "a") for k in range(30)] + [(k, "the hot text", "en", "a") for k in range(1000, 1200)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, lang, s, None, "x", 1, 2, 3, "y") for i, t, lang, s in rows[-230:]], SCHEMA))
    got = exact_dedup.exact_dedup(docs, fan_in=fan_in).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    whole = collections.Counter((re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"]) for r in stay.collect())
    assert whole == collections.Counter((t, min((i for i in ids if i is not None), default=None)) for t, ids in groups.items())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.drop_copies(empty(spark)).count() == 0


def test_merged_runs_stay_sorted(spark):
    """A round has one exchange and one sort, and its runs come out in digest order."""
    docs, _ = make_docs(spark)
    leaves = exact_dedup.leaf_runs(docs, "doc_id", "text", 4, 64)
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    order = leaves.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"), "run", "digest").collect()
    for _, part in itertools.groupby(sorted(order, key=lambda r: r["k"]), key=lambda r: r["p"]):
        for _, run in itertools.groupby(part, key=lambda r: r["run"]):
            digests = [bytes(r["digest"]) for r in run]
            assert digests == sorted(digests)


# mixing


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        level = rest / free if free else 0
        over = {s for s in names if s not in capped and weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("leaf_rows", [4096, 5])
def test_mixing(spark, leaf_rows):
    docs, rows = make_docs(spark, 3)
    got = mixing.mix(docs, leaf_rows=leaf_rows, fan_in=2).collect()
    assert len(got) == len(rows)
    sizes, own = collections.Counter(), collections.defaultdict(list)
    for i, t, _, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        own[s].append(n)
    want = water_fill(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["size"] == 0 or math.floor(rate) <= r["copies"] <= math.ceil(rate)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(own[s]) / 2 + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(7), leaf_rows=leaf_rows, fan_in=2).collect()
    key = lambda r: (str(r["id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_pivotal_keeps_expectations():
    import pandas as pd

    sums, n = np.zeros(8), 4000
    sizes, p = np.array([5, 9, 2, 7, 3, 8, 4, 6]), np.array([0.3, 0.5, 0.2, 0.7, 0.4, 0.6, 0.1, 0.9])
    r = np.random.default_rng(1)
    for _ in range(n):
        out = mixing.meet(pd.DataFrame({"size": sizes, "p": p, "u": r.random(8)}), False, 0)
        out = out.sort_values("size")["p"].to_numpy()
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert math.isclose((out * np.sort(sizes)).sum(), (p * sizes).sum())
        sums += out
    assert np.abs(sums / n - p[np.argsort(sizes)]).max() < 0.04


# sharding


def test_sharding(spark):
    docs, rows = make_docs(spark, 5, 200)
    got = sharding.shard(docs, n_shards=4).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, __import__("zlib").crc32((t or "").encode())) for i, t, *_ in rows)
    loads, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    longest = max(r["size"] for r in got)
    assert max(loads.values()) - sorted(loads.values())[0] <= longest
    cut = [k for k, x in homes.items() if len(x) > 1]
    assert len(cut) <= len(homes) // 50 + 1
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_splits_a_hot_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text everywhere").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    loads = {r["shard"]: r["b"] for r in sharding.shard(docs, n_shards=4).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(loads.values()) <= 1.02 * min(loads.values())


def slow_cuts(rows, shards):
    """Shards of each group of equal texts."""
    homes = collections.defaultdict(set)
    for (i, t), s in zip(rows, shards):
        homes[t or ""].add(s)
    return homes


@pytest.mark.parametrize("case", ["half", "all", "tenth", "nulls", "null_ids"])
def test_sharding_of_hot_groups(spark, case):
    """Against brute force: light groups are whole, a heavy one lies in the fewest shards or one more, sizes are even."""
    r, hot = random.Random(3), "the same text everywhere"
    share = {"half": 2, "all": 1, "tenth": 10, "nulls": 3, "null_ids": 3}[case]
    rows = [((None if case == "null_ids" else k) if k % share == 0 else k, (None if case == "nulls" else hot) if k % share == 0 else f"text {k if r.random() < 0.7 else k // 50}" + " word" * r.randrange(9)) for k in range(8000)]
    got = sharding.shard(spark.createDataFrame([(i, t, j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, size int"), n_shards=16).collect()
    assert collections.Counter((g["id"], g["size"]) for g in got) == collections.Counter((i, len(t or "") + 1) for i, t in rows)
    loads, slots, homes, sizes, by_crc = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for _, t in rows:
        sizes[t or ""] += len(t or "") + 1
        by_crc[__import__("zlib").crc32((t or "").encode())].add(t or "")
    for g in got:
        loads[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        homes[g["text_crc32"]].add(g["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(loads) == 16
    total, n = sum(loads.values()), collections.Counter(t or "" for _, t in rows)
    assert max(loads.values()) - min(loads.values()) <= 0.1 * total / 16
    for crc, texts in by_crc.items():
        if len(texts) == 1:
            t = next(iter(texts))
            heavy = sizes[t] > total // 128 or n[t] > 8000 // 128
            assert len(homes[crc]) <= (math.ceil(sizes[t] / (total / 16)) + 1 if heavy else 1), t


# language


def test_language_id(spark):
    docs, rows = make_docs(spark, 7, 300)
    held = language_id.held_out("doc_id")
    model = language_id.fit(docs.filter(~held), sample_docs=100)
    got = {r["id"]: r for r in language_id.identify(docs, model).collect() if r["id"] is not None}
    right = [got[i]["lang_pred"] == lang for i, t, lang, _ in rows[:300] if got[i]["id"] is not None]
    assert sum(right) / len(right) > 0.97
    assert [got[300 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[308]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 4
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.fit(empty(spark))
    assert none is None and language_id.identify(docs, none).filter("lang_pred <> 'und'").count() == 0


def test_language_id_loses_no_language(spark):
    r = random.Random(3)
    text = lambda lang: " ".join(r.choice(VOCABULARY[lang]) for _ in range(12))
    rows = [(None, text("fr"), "fr") for _ in range(300)] + [(k, text("en"), "en") for k in range(300)] + [(7, "xyz zyx xyz", "zz")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_docs=20)
    assert model.languages == ["en", "fr", "zz"]
    again = language_id.fit(docs.repartition(5), sample_docs=20)
    assert np.array_equal(model.bits, again.bits)
    small = language_id.fit(docs, sample_docs=20, max_cells=model.bits.size - 1)
    assert small.languages == model.languages and small.bits.size < model.bits.size
    assert language_id.fit(docs, sample_docs=20, sample_bytes=1).languages == model.languages
    with pytest.raises(ValueError):
        language_id.fit(docs, max_languages=2)


def test_language_id_on_held_out_rows(spark):
    """Accuracy on rows that were not learnt from."""
    docs, rows = make_docs(spark, 17, 400)
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")), sample_docs=100)
    mine = [(r["lang_pred"], r["id"]) for r in language_id.identify(docs, model).filter(language_id.held_out("id")).collect()]
    lang = {i: x for i, _, x, _ in rows[:400]}
    right = [p == lang[i] for p, i in mine if i in lang]
    assert len(right) > 80 and sum(right) / len(right) > 0.97


def test_slices_bound_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "CALL_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", None, b"x" * 50, b"", b"abcdef", b"abcdef"], pa.binary())], names=["t"])
    parts = [p.column(0).to_pylist() for p in language_id.slices(batch, 0)]
    assert sum(parts, []) == batch.column(0).to_pylist() and [len(p) for p in parts] == [2, 1, 2, 1]


def slow_bits(samples, text, order):
    """PPM with method C by counting, one symbol at a time."""
    symbols = sorted(set(b"".join(t for _, t in samples)) | {32})
    n, out = len(symbols) + 1, {}
    for lang in {x for x, _ in samples}:
        counts = collections.defaultdict(collections.Counter)
        s = b"".join(b" " * order + t for x, t in samples if x == lang)
        for k in range(order + 1):
            for j in range(k, len(s)):
                counts[s[j - k : j]][s[j]] += 1
        total, padded = 0.0, b" " * order + text
        for j in range(order, len(padded)):
            p, byte = 1.0, padded[j] if padded[j] in symbols else -1
            for k in range(order, -1, -1):
                c = counts.get(bytes(x if x in symbols else 0 for x in padded[j - k : j]))
                if c is None:
                    continue
                whole = sum(c.values()) + len(c)
                if c[byte]:
                    p *= c[byte] / whole
                    break
                p *= len(c) / whole
            else:
                p /= n
            total -= math.log2(p)
        out[lang] = total
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(order):
    samples = [("a", b"abra cadabra abra"), ("b", b"banana bandana"), ("a", b"arab")]
    model = language_id.train(samples, order)
    texts = [b"abra banana", b"", b"zzz abq", b"a"]
    bits, sizes = language_id.code_lengths(model, texts)
    for k, t in enumerate(texts):
        want = slow_bits(samples, t, order)
        assert np.allclose(bits[k], [want[x] for x in model.languages], rtol=1e-4)
    language_id.SLICE, old = 7, language_id.SLICE
    try:
        assert np.allclose(language_id.code_lengths(model, texts)[0], bits, atol=1e-3)
    finally:
        language_id.SLICE = old


# SentencePiece


def test_sentencepiece(spark):
    import sentencepiece

    docs, rows = make_docs(spark, 9, 20)
    rows += [(900, "  two  spaces\n<s> é 你好 😀 \x00 ▁ </s>", "en", "a")]
    docs = docs.unionByName(spark.createDataFrame([(900, rows[-1][1], "en", "a", None, "x", 1, 2, 3, "y")], SCHEMA))
    plain = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    got = sentencepiece_codec.encode(docs)
    for r in got.collect():
        text = next(t or "" for i, t, *_ in rows if i == r["id"])
        assert list(r["ids"]) == plain.encode(text) and r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    back = sentencepiece_codec.decode(got)
    assert all(r["decoded"] == next(t or "" for i, t, *_ in rows if i == r["id"]).replace("▁", " ") for r in back.collect())
    assert sentencepiece_codec.encode(empty(spark)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_sentencepiece_parity_on_any_text(text):
    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        c = sentencepiece_codec.codec(f.read(), 1)
    ids, same, back = c.encode([text, text + " " + text])
    assert same == [True, True] and ids[1] == c.plain.encode(text + " " + text)
    assert back[0] == text.replace("▁", " ") and back == c.plain.decode(ids)


# URLs


def wire_field(number, value):
    """A field of a protobuf message: an integer, a float or bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(kind, pieces, byte_fallback=True, remove_extra=False, dummy_prefix=True):
    """A model written by hand: pieces and their scores are given, nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback] + [(t, s, 1) for t, s in pieces]
    out = b"".join(wire_field(1, wire_field(1, t.encode()) + wire_field(2, float(s)) + wire_field(3, k)) for t, s, k in pieces)
    out += wire_field(2, wire_field(3, kind) + wire_field(35, int(byte_fallback)))
    return out + wire_field(3, wire_field(1, b"identity") + wire_field(3, int(dummy_prefix)) + wire_field(4, int(remove_extra)) + wire_field(5, 1))


UNIGRAM_PIECES = [(c, -6.0 - k / 40) for k, c in enumerate("\u2581abcdefghijklmnopqrstuvwxyz\u00e9.")] + [("\u2581the", -2.0), ("th", -3.5), ("he", -3.25), ("ing", -3.0), ("\u2581an", -2.75), ("and", -3.125), ("\u2581and", -2.5), ("er", -3.75)]
BPE_PIECES = [(x, -float(k)) for k, x in enumerate(["th", "he", "an", "\u2581th", "\u2581the", "and", "\u2581a", "in", "ing", "er", "\u2581and"])] + [(c, -20.0 - k) for k, c in enumerate("\u2581abcdefghijklmnopqrstuvwxyz\u00e9.")]
CROSSING = [("e\u2581", -0.25), ("e\u2581a", -0.5), ("\u2581\u2581", -1.5)]


@pytest.mark.parametrize("kind,pieces", [(1, UNIGRAM_PIECES), (2, BPE_PIECES), (1, UNIGRAM_PIECES + CROSSING), (2, BPE_PIECES + CROSSING), (1, UNIGRAM_PIECES + CROSSING[2:]), (2, BPE_PIECES + CROSSING[2:])])
@pytest.mark.parametrize("remove_extra,dummy_prefix", [(False, True), (True, True), (False, False)])
def test_sentencepiece_models_of_each_kind(kind, pieces, remove_extra, dummy_prefix):
    own = sentencepiece_codec.Codec(model_file(kind, pieces, remove_extra=remove_extra, dummy_prefix=dummy_prefix), 2)
    assert (sentencepiece_codec.splitter(own.spec) is None) == (CROSSING[0] in pieces)
    r = random.Random(kind)
    texts = ["", " ", "the and", "  the   and ", "\tthe", "\u00e9\u4f60 <s> the", "the " * 300] + [" ".join(r.choice(["the", "thing", "and", "other", "", "anderer", "\u00e9t\u00e9", "\u597d", "x.y"]) for _ in range(r.randrange(30))) for _ in range(60)]
    ids, same, back = own.encode(texts)
    assert ids == own.plain.encode(texts) and all(same)
    assert back == own.plain.decode(ids)
    assert own.decode([[5, 250, 3 + 0xC3, 3 + 0xA9, 3 + 0xFF]]) == own.plain.decode([[5, 250, 3 + 0xC3, 3 + 0xA9, 3 + 0xFF]])


@pytest.mark.parametrize("pieces", [BPE_PIECES, BPE_PIECES + CROSSING[2:]])
def test_sentencepiece_merges_runs_of_words(pieces):
    """A BPE model is given runs of words, and ids don't depend on where they end; before, each word was a slice."""
    own = sentencepiece_codec.Codec(model_file(2, pieces), 1)
    size, r = sentencepiece_codec.RUN_WORDS, random.Random(2)
    texts = [" ".join(r.choice(["the", "", "and", "other", "thing."]) for _ in range(n)) for k in (1, 2, 7) for n in (k * size - 1, k * size, k * size + 1)] + [" " * (3 * size), "a" * 40 * size]
    slices = [len(own.fast.pre_tokenizer.pre_tokenize_str(x)) for x in own.normalize(texts)]
    assert max(slices) <= 8
    ids, same, back = own.encode(texts)
    assert ids == own.plain.encode(texts) and all(same) and back == own.plain.decode(ids)


PEAK = """
import re
import pyarrow as pa
from lakeweave.llm import sentencepiece_codec as c

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

with open(c.DEFAULT_MODEL, "rb") as f:
    own = c.Codec(f.read(), 2)
words = ["".join(chr(97 + (7 * k + j * j) % 26) for j in range(2 + k % 9)) for k in range(1000)]
texts = pa.array([" ".join(words[(13 * k + j * (k % 7 + 1)) % 1000] for j in range(500)) for k in range(1200)])
c.release()
open("/proc/self/clear_refs", "w").write("5")
before = peak()
for at, part in c.calls(texts):
    c.coded(own, texts.slice(at, len(part)), part, True)
print(peak() - before)
"""


def test_sentencepiece_holds_little_of_a_batch():
    """Coding a batch adds 27 MB at its peak; in calls of 1 MB, as before, it added 89 MB, for each of an executor's tasks."""
    grown = subprocess.run([sys.executable, "-c", PEAK], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, check=True)
    assert float(grown.stdout) < 75


def test_sentencepiece_calls_hold_whole_texts_within_bounds():
    size = sentencepiece_codec.CALL_BYTES
    texts = ["a" * (size // 2), "\u00e9" * (size // 4), None, "b", "", "c" * (3 * size), "d"] + [None, ""] * sentencepiece_codec.CALL_ROWS
    got = list(sentencepiece_codec.calls(pa.array(["x", *texts], pa.string()).slice(1)))
    assert [t for _, part in got for t in part] == [t or "" for t in texts]
    assert [at for at, _ in got] == [sum(len(part) for _, part in got[:k]) for k in range(len(got))]
    assert all(len(part) <= sentencepiece_codec.CALL_ROWS and (len(part) == 1 or sum(len(t.encode()) for t in part) <= size) for _, part in got)
    assert len(got[0][1]) == 3 and [len(t) for t in got[2][1]] == [3 * size]
    assert list(sentencepiece_codec.calls(pa.array([], pa.string()))) == []


def test_sentencepiece_parity_is_seen(monkeypatch):
    """A rebuilt tokenizer that differs is reported, and the library's ids are emitted."""
    own = sentencepiece_codec.Codec(model_file(2, BPE_PIECES), 1)
    wrong = sentencepiece_codec.build(sentencepiece_codec.parse_model(model_file(2, BPE_PIECES[5:] + BPE_PIECES[:5])))
    own.fast, own.marks = wrong, False
    ids, same, _ = own.encode(["the and", ""])
    assert same == [False, True] and ids[0] == own.plain.encode("the and")


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def rule_of_url(url):
    """host, path, rule and verdict of a URL by the contract's words."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([j for j in (rest.find(c) for c in "/?#") if j >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = re.split(r"[?#]", rest[cut:])[0]
    return host, path, *slow_rule(host, path)


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/fr/", "http://notexample.net", "http://x.example.com/de/1", "http://x.example.com/dex", "http://a.org/fr/2", "ftp://net/", "no scheme", None, "", "http://spam-farm.example.org/en/1", "https://museum.example.org/en/1", "http://é.NET/É", "http://h?a://b/c", "http://" + "a" * 5000 + ".net/"]
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["id"]: r for r in url_filter.judge(pages).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = rule_of_url(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert verdict is None or got[k]["verdict"] == verdict
    assert got[8]["verdict"] == "allow" and got[9]["score"] == 0
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_on_held_out_hosts(spark):
    figures = url_filter.held_out_figures(spark)
    assert figures["rows"] > 300 and figures["precision"] > 0.85 and figures["recall"] > 0.85
    # the path decides too: a known host with blocked and with ordinary topics
    urls = [f"http://harbor.example.org/{p}" for p in ("casino/poker-bonus/free-viagra", "museum/history/letters")]
    assert [r["verdict"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=[]).orderBy("id").collect()] == ["block", "allow"]
    with pytest.raises(ValueError):
        url_filter.train(spark, [("http://a.b", 1)] * (url_filter.MAX_LABELLED + 1))


# WARC


def test_warc(spark, tmp_path):
    pages = [(1, "http://a.b/x", "<p>é</p>"), (2, "http://a.b/x", "<p>é</p>"), (3, "http://b.b/\nq", None), (4, None, ""), (5, "https://c.a.b/y?z#f", "long " * 50_000), (6, "http://a.b", "one"), (6, "http://a.b", "one"), (None, "http://z", "none")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, key string, offset int")
    stored = warc.archive(df, f"file:{tmp_path}/w", block_lines=2)
    got = sorted(warc.read_all(stored, with_payload=True).collect(), key=lambda r: (r["id"] is None, r["id"] or 0))
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, 6, None]
    by = collections.defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    for r, (i, _, h) in zip(got, sorted(pages, key=lambda p: (p[0] is None, p[0] or 0))):
        data = (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        top = max((x for x in by[h or ""] if x is not None), default=None)
        if i == top:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == data
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == top and r["payload"] is None
    assert sorted(x["page_id"] for x in stored.lookup("http://A.B/x")) == ["1", "2"]
    assert list(stored.lookup("http://nowhere/")) == [] and len(list(stored.lookup("http://a.b"))) == 2
    assert warc.read_all(warc.archive(df, f"file:{tmp_path}/v", min_bytes=5)).filter("id = 3").first()["record_type"] == "response"
    assert warc.read_all(warc.archive(df.limit(0), f"file:{tmp_path}/u")).count() == 0


def test_warc_lookup_against_brute_force(spark, tmp_path):
    """Every URL by binary search, with one URL over many blocks, and string identifiers."""
    r = random.Random(2)
    pages = [(f"p{k:03}", "http://hot.b/same" if k % 3 == 0 else r.choice(["http://h%d.c/%d" % (k % 7, k % 11), "HTTP://A%d.d?q=%d#f" % (k % 5, k), "plain%d" % (k % 4), "http://t.t/\t\\%d" % (k % 3)]), f"html {k % 20}") for k in range(150)]
    stored = warc.archive(spark.createDataFrame(pages, "page_id string, url string, html string"), f"file:{tmp_path}/w", block_lines=4)
    assert len(stored.files) > 1
    by = collections.defaultdict(list)
    for i, u, _ in pages:
        by[warc.url_key(u)].append(i)
    for _, u, _ in pages:
        assert sorted(x["page_id"] for x in stored.lookup(u)) == sorted(by[warc.url_key(u)])
    reads, entry = [], warc.Search._entry
    search = warc.Search(stored.folder, stored.files)
    search._entry = lambda name, k: reads.append(k) or entry(search, name, k)
    assert list(search.captures("zzz)/nowhere")) == [] and list(search.captures("")) == []
    assert len(list(search.captures(warc.url_key("http://h1.c/1")))) == len(by[warc.url_key("http://h1.c/1")]) and len(reads) < 20
    got = {x["id"]: x for x in warc.read_all(stored).collect()}
    last = {h: max(i for i, _, g in pages if g == h) for _, _, h in pages}
    assert all(got[i]["refers_to"] == (None if last[h] == i else last[h]) and got[i]["payload_bytes"] == len(h) for i, _, h in pages)


# chat


@given(st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "\\", "[", "<s>", "a", " ", "[\\INST]", "<\\\\s>", "[ROLE]", "[:]", "/INST]", "\n"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible_by_regex(parts):
    text = "".join(parts)
    first, rest = chat._FIRST, chat._REST
    escaped = re.sub(first + r"(\\*)(" + rest + ")", r"\1\\\2\3", text)
    assert not re.search(first + "(" + rest + ")", escaped)
    assert re.sub(first + r"\\(\\*)(" + rest + ")", r"\1\2\3", escaped) == text


def test_chat(spark):
    rows = [(1, 0, "user", "hi [INST] </s>"), (1, 1, "assistant", "<s>yo [\\INST]"), (1, 2, "tool", "a[:]b[/ROLE]"), (2, 5, "system", None), (2, 3, None, "x"), (3, 0, "user", ""), (3, 0, "user", ""), (4, None, "assistant", "n"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    done = chat.format_trees(chat.as_chain(df, "conv_id", "turn", "role", "text"))
    got = {r["conv"]: r for r in done.select("conv", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(x["role"], x["text"]) for x in got[conv]["back"]] == [(role, text) for _, role, text in turns]
        spans = [got[conv]["formatted"][s["start"] : s["end"]] for s in got[conv]["loss_spans"]]
        assert len(spans) == sum(role == "assistant" for _, role, _ in turns)
    assert got[1]["formatted"].startswith("[INST]hi [\\INST] <\\/s>[/INST]<s><\\s>yo [\\\\INST]</s>[ROLE]tool[:]")
    assert chat.format_trees(chat.as_chain(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


def test_reply_trees_rank_branches(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 2, "user", "more", 1.0), (1, 5, 4, "assistant", "deep", 2.0), (2, 1, None, "user", "alone", 1.0)]
    df = spark.createDataFrame(nodes, "conv long, node long, parent long, role string, text string, score double")
    got = {(r["conv"], r["rank"]): r["formatted"] for r in chat.format_trees(df, top=2).collect()}
    assert got == {(1, 1): "[INST]q[/INST]<s>good</s>", (1, 2): "[INST]q[/INST]<s>bad</s>[INST]more[/INST]<s>deep</s>", (2, 1): "[INST]alone[/INST]"}


def test_reply_trees_against_brute_force(spark):
    """Random forests with missing parents and circles: sums, ranks and paths by walking up."""
    r = random.Random(6)
    nodes = []
    for conv in range(12):
        n = r.randrange(1, 40)
        for k in range(n):
            parent = None if k == 0 or r.random() < 0.1 else r.randrange(k) if r.random() < 0.9 else 1000
            nodes.append((conv, k, parent, r.choice(["user", "assistant", "tool"]), f"t{k}", float(r.randrange(5))))
    nodes += [(50, 1, 3, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (50, 3, 2, "user", "c", 1.0), (50, 4, 3, "user", "below", 9.0), (50, 5, None, "user", "root", 0.5), (51, 1, 1, "user", "itself", 1.0)]
    nodes += [(52, k, k - 1 if k else None, "assistant", f"deep{k}", 1.0) for k in range(130)]
    df = spark.createDataFrame([(*x, "z") for x in nodes], "conv long, node long, parent long, role string, text string, score double, total string")
    by = {(c, n): (p, role, t, s) for c, n, p, role, t, s in nodes}
    want = {}
    for conv in {c for c, *_ in nodes}:
        parents = {p for c, _, p, *_ in nodes if c == conv}
        branches = []
        for c, n, *_ in nodes:
            if c == conv and n not in parents:
                path, at = [], n
                while at is not None and (conv, at) in by and at not in path:
                    path.append(at)
                    at = by[conv, at][0]
                if at not in path:
                    branches.append((-sum(by[conv, x][3] for x in path), -len(path), n, path[::-1]))
        for rank, (_, _, leaf, path) in enumerate(sorted(branches)[:2], 1):
            want[conv, rank] = (leaf, [(by[conv, x][1], by[conv, x][2]) for x in path])
    got = {}
    for x in chat.format_trees(df, top=2).withColumn("back", chat.read_back(F.col("formatted"))).collect():
        got[x["conv"], x["rank"]] = (x["leaf"], [(t["role"], t["text"]) for t in x["back"]])
        assert [x["formatted"][s["start"] : s["end"]] for s in x["loss_spans"]] == [t["text"] for t in x["back"] if t["role"] == "assistant"]
    assert got == want


# n-gram join


def slow_components(rows, size=5, percent=75):
    low = {k: k + 32 for k in range(65, 91)}
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return sorted((str(i), len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("seed,block_rows", [(11, 256), (12, 2)])
def test_ngram_join(spark, seed, block_rows):
    docs, rows = make_docs(spark, seed, 120)
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block_rows=block_rows).collect())
    assert got == slow_components(rows)
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_ngram_join_of_a_family_around_no_hub(spark):
    """Copies of copies: neighbours link, ends don't, and no row links with all."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words), "en", "a"))
        words[k * 15 : k * 15 + 12] = [f"c{k}_{j}" for j in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block_rows=3).collect())
    assert got == slow_components(rows)


def test_ngram_join_splits_shared_columns(spark):
    """Columns that many rows share travel apart from the others; families and a passage in all texts keep their answer."""
    r = random.Random(8)
    passage = " ".join(f"shared{k}" for k in range(30))
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(50):
        words = list(base)
        words[r.randrange(90)] = f"c{k}"
        rows.append((k, " ".join(words), "en", "a"))
    rows += [(100 + k, passage + " " + " ".join(f"o{k}_{j}" for j in range(40)), "en", "a") for k in range(40)]
    rows += [(200 + k, passage, "en", "a") for k in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(3)
    blocks = ngram_join.incidence(docs, "doc_id", "text", 5, 4)
    assert blocks.filter(F.col("kind") == ngram_join.SPLIT).count() > 50
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block_rows=8).collect())
    assert got == slow_components(rows)


def test_tile_counts_overlaps():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(-40, 40, n)) for n in (1, 5, 30, 60, 60, 12)]
    tile = ngram_join.Tile([(k, len(x), k, x) for k, x in enumerate(sets)])
    ngram_join.STEP, old = 7, ngram_join.STEP
    try:
        got = tile.overlaps(sets)
    finally:
        ngram_join.STEP = old
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_ngram_join_writes_small_tables_as_few_files(spark, monkeypatch):
    """At 64 shuffle partitions a few rows were 64 files, and packed entries a batch for each of 64 parts."""
    import os

    import pyarrow as pa

    from lakeweave.llm import common
    from lakeweave.llm import components as parts_of

    pieces = [(k, b"a" * 16, b"\1\0\0\0", b"h" * 8, None) for k in range(64)]
    batches = list(ngram_join._Out(pa.int64()).entries(iter(pieces)))
    assert [b.num_rows for b in batches] == [64] and batches[0].column("part").to_pylist() == list(range(64))
    files = {}

    def counted(df, name, most=None):
        table = common.materialize(df, name, most)
        files.setdefault(name, []).append(sum(x.endswith(".parquet") for x in os.listdir(table._lw_path.removeprefix("file://"))))
        return table

    monkeypatch.setattr(parts_of, "materialize", counted)
    monkeypatch.setattr(ngram_join, "materialize", counted)
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{body} x{k}") for k in range(30)] + [(100 + k, " ".join(f"v{k}_{j}" for j in range(20))) for k in range(30)]
    rows += [(200 + k, " ".join(f"u{j}" for j in range(9 * k, 9 * k + 90))) for k in range(12)]  # a chain, linked without a hub
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, block_rows=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == slow_components(rows)
    narrow = {"edges", "lowest", "step", "roots", "pairs", "pivots", "chunks", "members", "loose", "classes"}
    assert narrow <= set(files) and max(max(files[name]) for name in narrow) <= 8, files


@pytest.mark.parametrize("seed", range(3))
def test_joined_roots(spark, seed):
    """Components of links between roots join the components before to those of all links."""
    draw = random.Random(seed)
    first = [(draw.randrange(60), draw.randrange(60)) for _ in range(25)]
    first = [(a, b) for a, b in first if a != b]
    as_frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    before = components(as_frame(first))
    root = {r["node"]: r["root"] for r in before.collect()}
    more = [(draw.randrange(70), draw.randrange(70)) for _ in range(20)]
    between = [(root.get(a, a), root.get(b, b)) for a, b in more]
    between = [(a, b) for a, b in between if a != b]
    got = {r["node"]: r["root"] for r in ngram_join.joined_roots(before, components(as_frame(between))).collect()}
    assert got == {r["node"]: r["root"] for r in components(as_frame(first + between)).collect()}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    best = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    assert got == best


# quality


def slow_base(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for k, t in enumerate(zip(w, w[1:], w[2:])) if count[t] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), dup, len(covered)


def test_quality(spark):
    docs, rows = make_docs(spark, 13)
    junk = [(500, "\n".join(["Home | About | Login | Help | Shop | Cart |"] * 3 + [f"w{k}### x$$$ y%%% z{k}&&& | Buy!! NOW!!" for k in range(20)]), "en", "a")]
    prose = [(501, "\n".join(f"The quiet river number {k} ran past the old mill and on to the sea." for k in range(20)), "en", "a")]
    extra = spark.createDataFrame([(i, t, lang, s, None, "x", 1, 2, 3, "y") for i, t, lang, s in junk + prose], SCHEMA)
    docs, rows = docs.unionByName(extra), rows + junk + prose
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r["id"]: r for r in quality.score_quality(docs, model).collect()}
    for i, t, *_ in rows:
        r = got[i]
        base = slow_base(t)
        if i is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
            assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["base_failed"] and r["kept"])
    assert not got[500]["kept"] and got[501]["content_share"] > 0.9
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_learns_from_all_lines(spark):
    prose = lambda n, k: [f"The quiet river number {k} of {j} ran past the old mill and on to the sea." for j in range(n)]
    junk = [f"w{k}### x$$$ y%%% z{k}&&& | Buy!! NOW!!" for k in range(40)]
    texts = [(k, "\n".join(prose(120, k) + (junk if k % 2 else []))) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    emit, step = quality.fit(docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("quality")))
    rows = np.array(quality.read_document("\n".join(prose(150, 77) + junk), quality._Memo())[1])
    assert quality.viterbi(rows, emit, step).tolist() == [quality.CONTENT] * 150 + [quality.BOILERPLATE] * 40


def test_quality_learns_from_one_row_of_each_identifier(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda samples: seen.append(sorted((len(rows), bool(labels.any())) for labels, rows in samples)))
    texts = [(0, f"The quiet river ran past mill number {j} and on to the sea.") for j in range(300)] + [(k, "\n".join([f"w{k}### x$$$ y%%% | Buy!! NOW!!"] * (k + 1))) for k in range(1, 6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    labels = docs.select("doc_id", (F.col("doc_id") == 0).cast("int").alias("quality"))
    quality.fit(docs, labels, sample_docs=5)
    assert seen == [[(1, False)] + [(k + 1, True) for k in range(1, 6)]]


def test_quality_with_clashing_names(spark):
    prose = "\n".join(f"The quiet{k} river{k} ran{k} past{k} mill{k} and sea{k}." for k in range(20))
    junk = "\n".join(f"w{k}### x$$$ y%%% z{k}&&& | Buy!! NOW!!" for k in range(20))
    rows = [(k, prose + f" {k}" if k % 2 else junk + f" {k}", None, "x", 0, "z", "a", "b") for k in range(12)] + [(None, prose, None, "x", 0, "z", "a", "b"), (0, None, None, "x", 0, "z", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean, _id string, h int, k string, _text string, _doc string")
    labels = spark.createDataFrame([(k, k % 2, "q") for k in range(12)] * 2 + [(None, 1, "q"), (3, None, "q")], "doc_id long, quality int, good string")
    kept = {r["id"]: r["kept"] for r in quality.score_quality(docs, quality.fit(docs, labels)).filter("id IS NOT NULL").groupBy("id").agg(F.max("kept").alias("kept")).collect()}
    assert kept == {k: bool(k % 2) for k in range(12)}
    assert quality.fit(docs, labels.limit(0))[0].shape == quality.fit(docs.limit(0), labels)[0].shape


def test_line_labels_and_gradient():
    """Line labels split a bad document; training reaches a likelihood that small changes of a weight don't beat."""
    r = np.random.default_rng(5)
    content = lambda n: np.hstack([np.ones((n, 1)), r.normal(0, 0.01, (n, len(quality.FEATURES) - 1))])
    junk = lambda n: np.hstack([np.ones((n, 1)), r.normal(1, 0.01, (n, len(quality.FEATURES) - 1))])
    labelled = quality.line_labels([(quality.CONTENT, content(8)), (quality.BOILERPLATE, np.vstack([content(3), junk(5)])), (quality.BOILERPLATE, junk(4))])
    assert [x.tolist() for x, _ in labelled] == [[0] * 8, [0, 0, 0, 1, 1, 1, 1, 1], [1] * 4]

    def likelihood(emit, step):
        total, mass = 0.0, 0.0
        for y, x in labelled:
            score = lambda z: sum(x[k] @ emit[z[k]] for k in range(len(z))) + sum(step[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            w = 1 / math.sqrt(len(x))
            total += w * (score(y) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=len(y)))))
            mass += w * len(x)
        return total / mass * 4 - 1e-3 / 2 * (emit**2).sum()

    emit, step = quality.train(labelled, steps=4000)
    best = likelihood(emit, step)
    for j in range(3):
        for d in (-0.2, 0.2):
            other = emit.copy()
            other[0, j] += d
            assert likelihood(other, step) < best


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(2)
    for _ in range(20):
        x, emit, step = r.normal(size=(6, 4)), r.normal(size=(2, 4)), r.normal(size=(2, 2))
        score = lambda y: sum(x[k] @ emit[y[k]] for k in range(6)) + sum(step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert math.isclose(score(quality.viterbi(x, emit, step)), max(map(score, itertools.product((0, 1), repeat=6))))
