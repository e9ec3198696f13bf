"""Near-duplicate classes and packing against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, simhash, tokens

SCHEMA = "doc_id long, text string, fp string, n_chars int"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(fps):
    parent = list(range(len(fps)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("a B c é d\n \t".split(" ")), max_size=60))
def test_fingerprint(words):
    assert simhash.fingerprint(" ".join(words).encode()) == plain_fingerprint(" ".join(words))


@pytest.mark.parametrize("hot,part,few", [(simhash.HOT, simhash.PART, 10**6), (20, 16, 10**6), (20, 16, 0)])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, hot, part, few):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BROADCAST_HOT", few)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base[:8]:
        near = [b]
        for _ in range(120):
            x = rng.choice(near)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            near.append(x)
        fps.update(near)
    fps.update(base[9] ^ (rng.getrandbits(28) << 2) for _ in range(600))  # a family under one key
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.classes(simhash.links(frame, hot_size=hot)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for x, c in zip(fps, plain_classes(fps)):
        want[c].add(x)
        got[roots.get(simhash.signed(x), simhash.signed(x))].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_parts_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64) * np.uint64(1 << 20))
    want = plain_classes(fps.tolist())
    for size in (4, 60, 10**6):
        monkeypatch.setattr(simhash, "PART", size)
        a, b = simhash._link(np.zeros(len(fps), np.int64), fps, simhash.pivots())
        roots = dict(zip(a.tolist(), b.tolist()))
        assert len({(roots.get(int(x), int(x)), c) for x, c in zip(fps, want)}) == len(set(want))


def test_large_families_take_little_time():
    import time

    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 28, 200_000).astype(np.uint64) << np.uint64(3))
    began = time.perf_counter()
    simhash._link(np.zeros(len(fps), np.int64), fps, simhash.pivots())
    assert time.perf_counter() - began < 60, "all pairs would be 2e10"


def test_components_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(4, long, "x", 1), (2, long + " more", "x", 1), (9, None, None, None), (3, "", "x", 0), (None, "alone here now ok", "x", 1), (4, long, "x", 1), (7, " \n", "x", 2), (8, "Other words entirely in this one", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (2, 2), (3, 3), (4, 2), (4, 2), (7, 3), (8, 8), (9, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3, 8]
    with pytest.MonkeyPatch.context() as patch:  # more keys than are broadcast
        patch.setattr("millrace.llm.common.BROADCAST_KEYS", 0)
        assert sorted(map(str, simhash.keep_one(docs).collect())) == sorted(map(str, kept.collect()))
    again = spark.createDataFrame([rows[0], rows[0], rows[7]], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.keep_one(again).collect()) == [4, 8]
    assert simhash.components(docs.limit(0)).count() == 0


LIBRARIES: dict = {}
TEXTS = st.lists(st.sampled_from(["Hello", "wörld,", " ", " ", "\n", "  ", "\t", "don't", "12", " ", "　", "é", "\x01", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "|>", "y" * 70, "\U0001f600", "x\r", " ", "#"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_ids_are_those_of_whole_texts(texts):
    for kind, path in ((tokens.ByteTokens, BYTE), (tokens.WordTokens, WORD)):
        t = kind.load(path)
        got = [np.frombuffer(x, kind.type).tolist() for x in t.encode([x.encode() for x in texts])]
        library = LIBRARIES.setdefault(path, Tokenizer.from_file(path))  # as it comes from the file
        assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_places_each_piece_once(sizes):
    capacity = 30
    records = packing.plan(Counter(sizes), capacity)
    placed, bins = Counter(), defaultdict(list)
    for s, first, count, sequence, offset in records:
        placed[s] += count
        for k in range(count):
            bins[sequence + k].append((offset, s))
    assert placed == Counter(sizes)
    for pieces in bins.values():
        at = 0
        for offset, s in sorted(pieces):
            assert offset == at
            at += s
        assert at <= capacity and sum(3 * s > capacity for _, s in pieces) <= 2
    assert len(bins) <= max(1.25 * -(-sum(sizes) // capacity) + 1, sum(2 * s > capacity for s in sizes) * 1.3 + 2, sum(3 * s > capacity for s in sizes))


@pytest.mark.parametrize("few", [packing.BROADCAST_OFFSETS, 0])
def test_pack_rows(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "BROADCAST_OFFSETS", few)
    rows = [(k, "word " * (k * 37 % 900) + "end", "x", 1) for k in range(200)] + [(1000, "long one " * 4000, "x", 1), (1001, None, "x", 1), (1002, "", "x", 1), (None, "no id", "x", 1), (3, "word end", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), BYTE, with_ids=True).collect()
    by_sequence = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    long = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got if r["doc_id"] == 1000)
    ids = Tokenizer.from_file(BYTE).encode("long one " * 4000, add_special_tokens=False).ids + [0]
    assert np.frombuffer(b"".join(x[3] for x in long), "<u4").tolist() == ids
    assert all(n == 2048 for _, _, n, _ in long[1:]) and [x[1] for x in long] == list(np.cumsum([0, *[x[2] for x in long[:-1]]]))
    assert sum(r["length"] for r in got if r["doc_id"] in (1001, 1002)) == 2
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE).count() == 0
