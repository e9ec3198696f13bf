"""Near-copy classes against all pairs."""

import random

import numpy as np
import pytest
from test_dedup_packing import SCHEMA

from millrace.llm import nearcopies, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def groups(labels):
    by = {}
    for i, x in enumerate(labels):
        by.setdefault(x, []).append(i)
    return sorted(by.values())


def corpus():
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for size in (60, 120, 300):
        for edits in (1, 2, 3, 4, 6, 9, 14):  # similarities from 0.98 down to well under 0.8
            base = fresh(size)
            texts.append(" ".join(base))
            for _ in range(4):
                own = list(base)
                for at in rng.sample(range(size), edits):
                    own[at] = fresh(1)[0]
                texts.append(" ".join(own))
    base = fresh(60)
    for k in range(120):  # two of them are 0.70 alike, and linked only by the text they come from
        own = list(base)
        own[5 + k % 50] = f"e{k}"
        texts.append(" ".join(own))
    return [*texts, " ".join(base)]


def template(n, share, size, seed, kinds=1):
    """Texts that share a template's words, in one stretch, and fill up with words of their own; every tenth is a near copy of the one before."""
    rng = random.Random(seed)
    heads, out = [[f"t{k}x{i}" for i in range(int(size * share))] for k in range(kinds)], []
    for i in range(n):
        own = heads[i % kinds] + [f"o{rng.randrange(10**9)}" for _ in range(size - len(heads[0]))]
        if i % 10 == 9:
            own = out[-1].split()
            own[rng.randrange(size)] = "edit"
        out.append(" ".join(own))
    return out


def near_by_array(texts):
    """plain_near, by the shingles' numbers."""
    number, sets = {}, []
    for t in texts:
        sets.append({number.setdefault(x, len(number)) for x in plain_set(t)})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def links_of(texts, heavy=None, roots=None):
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    nodes = list(range(len(texts)))
    parent = list(roots or nodes)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in nearcopies.block_links(nodes, roots or nodes, sets):
        parent[find(a)] = find(b)
    return [find(i) for i in nodes]


@pytest.mark.parametrize("share", [0.5, 0.75, 0.8, 0.84, 0.87, 0.89, 0.9, 0.93, 0.99])
@pytest.mark.parametrize("kinds", [1, 3])
def test_templates_are_told_from_copies(monkeypatch, share, kinds):
    monkeypatch.setattr(nearcopies, "HEAVY", 8)
    rng = random.Random(5)
    texts = template(60, share, 100, 1, kinds) + template(40, rng.choice([0.82, 0.95]), 100, 1, kinds)
    assert groups(links_of(texts)) == groups(near_by_array(texts))


def test_a_large_block_of_one_template_takes_little_time():
    import time

    texts = template(20_000, 0.75, 400, 2)
    began = time.perf_counter()
    found = groups(links_of(texts))
    assert time.perf_counter() - began < 120
    assert sorted(map(len, found)) == [1] * 16_000 + [2] * 2_000


def test_block_links_reach_what_all_pairs_reach():
    texts = [t for t in corpus() if t and t.strip()]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    for seed in range(3):
        order = random.Random(seed).sample(range(len(texts)), len(texts))
        nodes = list(range(len(order)))
        parent = list(nodes)
        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in nearcopies.block_links(nodes, nodes, [sets[i] for i in order]):
            parent[find(a)] = find(b)
        assert groups([find(i) for i in nodes]) == groups(plain_near([texts[i] for i in order]))


@pytest.mark.parametrize("part,chunk", [(256, 8192), (8, 16)])
def test_labels_are_those_of_all_pairs(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(nearcopies, "PART", part)
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["root"] for r in nearcopies.labels(docs).collect()}
    assert groups([got[k] for k in range(len(texts))]) == groups(plain_near(texts))


def test_pipeline_stage_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(min(g) for g in groups(plain_near(texts)))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_links_pass_fingerprints_and_pivots():
    texts = [t for t in corpus() if t and t.strip()] + template(60, 0.5, 100, 4)
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    fps = np.stack([nearcopies.fingerprint(s) for s in sets])
    bits = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert len(alike) > 500 and max(bits(i, j) for i, j in alike) <= nearcopies.RADIUS
    x, y = np.triu_indices(len(sets), 1)
    seen = [0, 0, 0]
    found = simhash.within(fps, simhash.measured(fps, nearcopies.PIVOTS), x, y, nearcopies.RADIUS, seen)
    assert {(a, b) for a, b in zip(x[found].tolist(), y[found].tolist())} == {(i, j) for i, j in zip(x.tolist(), y.tolist()) if bits(i, j) <= nearcopies.RADIUS}
    assert seen[0] == len(x) > 1.5 * seen[1] and seen[1] >= seen[2] == len(found)


def test_no_link_goes_round_the_fingerprints(monkeypatch):
    texts = [t for t in corpus() if t and t.strip()]
    nodes, sets, seen = list(range(len(texts))), [nearcopies.shingles(t.encode()) for t in texts], [0, 0, 0]
    found = nearcopies.block_links(nodes, nodes, sets, None, seen)
    assert len(found) <= seen[2] <= seen[1] <= seen[0]
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    assert not nearcopies.block_links(nodes, nodes, sets)
