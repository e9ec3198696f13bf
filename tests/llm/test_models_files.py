"""Language model, token files, sharding, URL filter, tool calls and the pipeline against plain versions."""

import itertools
import json
import math
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import hilbert, hmm, rangecoder, simhash, toolcalls

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, shard int, slot string"
ODD = [(1, "the cat sat", "s", "en", 11, 1, "x"), (2, None, None, None, None, None, None), (3, "", "s", "en", 0, 1, ""), (None, "no id", "s", "fr", 5, 1, "x"), (1, "the cat sat", "s", "en", 11, 1, "x"), (9, "é long " * 20000, "t", "de", 140000, 1, "x")]


def random_model(rng, states, classes):
    norm = lambda m, axis: m / m.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random((2, states)), 1), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def plain_likelihood(line, m):
    return sum(
        m.start[0][p[0]] * m.emit[line[0], p[0]] * math.prod(m.trans[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], line[1:]))
        for p in itertools.product(range(m.trans.shape[0]), repeat=len(line))
    )


def test_forward_is_the_sum_over_all_paths():
    m = random_model(np.random.default_rng(3), 3, 5)
    lines = [np.array(x) for x in ([0], [4, 4, 1], [1, 2, 3, 0, 2, 1], [2, 2])]
    assert np.allclose(hmm.log_likelihoods(lines, m), [math.log10(plain_likelihood(x, m)) for x in lines])
    short = [np.array(x) for n in range(1, 4) for x in itertools.product(range(5), repeat=n) if len(x) == 3]
    assert np.isclose((10 ** hmm.log_likelihoods(short, m)).sum(), 1)


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "CLASSES", 4)
    monkeypatch.setattr(hmm, "WINDOW", 4)
    m = random_model(np.random.default_rng(4), 2, 4)
    lines = [np.array(x) for x in ([0, 1, 2, 3, 3, 1], [2], [1, 1, 0, 2])]
    starts, moves, emits = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((4, 2))
    for line in lines:
        for at in range(0, len(line), 4):
            part, later = line[at : at + 4], int(at > 0)
            weights = {}
            for p in itertools.product(range(2), repeat=len(part)):
                weights[p] = m.start[later][p[0]] * m.emit[part[0], p[0]] * math.prod(m.trans[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], part[1:]))
            total = sum(weights.values())
            for p, w in weights.items():
                starts[later, p[0]] += w / total
                for a, b in zip(p, p[1:]):
                    moves[a, b] += w / total
                for x, s in zip(part, p):
                    emits[x, s] += w / total
    for got, want in zip(hmm.expected_counts(lines, m), (starts, moves, emits)):
        assert np.allclose(got, want, atol=1e-4)


def test_model_beats_word_counts_on_held_out_texts(spark):
    rng = np.random.default_rng(0)
    words = [[f"{l}{i}" for i in range(40)] for l in "ab"]
    rows = [(k, " ".join(rng.choice(words[k % 2], 60)), "s", "en", 1, 1, "x") for k in range(20, 420)] + ODD
    got = hmm.score(spark.createDataFrame(rows, SCHEMA), rounds=3, frequent=50).collect()
    assert len(got) == len(rows)
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in ((r[1] or "").lower().encode().split() + [b" "]))
    n, v = sum(counts.values()), len(counts)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        line = (r[1] or "").lower().encode().split() + [b" "]
        own = by_id[r[0]]
        assert own["train_tokens"] == n and own["n_tokens"] == len(line) and own["n_known"] == sum(counts[w] > 0 for w in line)
        assert own["held_out"] == (zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2)
        assert math.isclose(own["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in line), rel_tol=1e-9)
    held = [r for r in got if r["held_out"] and r["n_tokens"] == 61]
    assert sum(r["score"] - r["base_score"] for r in held) > 0.25 * sum(r["n_tokens"] for r in held)
    assert hmm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_are_a_plain_forward_pass_over_words(spark, monkeypatch):
    models, scored = [], hmm.score_symbols
    monkeypatch.setattr(hmm, "score_symbols", lambda encoded, model: models.append(model) or scored(encoded, model))
    monkeypatch.setattr(hmm, "CLASSES", 7)
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{i}" for i in rng.zipf(1.4, rng.integers(1, 200)) % 60), "s", "en", 1, 1, "x") for k in range(20, 120)] + ODD
    got = hmm.score(spark.createDataFrame(rows, SCHEMA), rounds=2, frequent=40, own=20).collect()
    (model,) = models
    line = lambda text: (text or "").lower().encode().split() + [b" "]
    counts = Counter(w for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2 for w in line(r[1]))
    n = sum(counts.values())
    own = sorted((w for w in counts if w != b" " and counts[w] > n // 20), key=lambda w: (-counts[w], w))
    assert own and len(own) < len(counts) - 1
    symbol = {w: i for i, w in enumerate([b" ", *own])}
    number = lambda w: symbol.get(w, len(symbol) + zlib.crc32(w) % 7)
    chance = lambda w: model.emit[number(w)] * (counts[w] + 1)
    unseen = model.emit[len(symbol) :].sum(0)  # each class leaves one part to words not in training
    assert np.allclose(sum(chance(w) for w in counts) + unseen, 1)
    by_id = {r["doc_id"]: r["score"] for r in got}
    for r in rows:
        a, total = None, 0.0
        for w in line(r[1]):
            a = (model.start[0] if a is None else a @ model.trans) * chance(w)
            total += math.log10(a.sum())
            a /= a.sum()
        assert math.isclose(by_id[r[0]], total, rel_tol=1e-9)


IDS = st.one_of(st.integers(0, 3), st.integers(0, rangecoder.IDS - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(IDS, max_size=300), st.integers(1, 40))
def test_blocks_round_trip(ids, times):
    block = np.array(ids * times, np.int64)
    assert (rangecoder.decode_block(rangecoder.encode_block(block), len(block)) == block).all()


def test_blocks_learn():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 49000, rng.integers(1, 5)) for _ in range(3000)]
    block = np.concatenate([words[k] for k in (rng.zipf(1.3, 60000) % 3000)])
    share = np.bincount(block) / len(block)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    data = rangecoder.encode_block(block)
    assert (rangecoder.decode_block(data, len(block)) == block).all()
    assert 8 * len(data) < 0.8 * entropy * len(block), "the orders together beat the best fixed order 0"


def test_the_orders_sum_to_one():
    m = rangecoder._Mixer(1)
    for x in [5, 9, 5, 9, 5, 9, 5, 9, 5, 7, 5]:
        m.look(1)
        rest = 65536 - int(m.p_a[0]) - int(m.p_b[0])
        assert rest >= rangecoder._LEAST and int(m.w2[0] + m.w1[0]) <= 65536 - rangecoder._LEAST
        m.learn(np.array([x]), np.array([x]) == m.a, np.array([x]) == m.b, 1)
    m.look(1)
    assert (int(m.a[0]), int(m.b[0])) in {(7, 9), (9, 7), (9, rangecoder.IDS), (rangecoder.IDS, 9), (rangecoder.IDS, 7)}


def test_segments_are_checked(monkeypatch):
    docs = [np.arange(5, dtype=np.uint16), np.tile(np.array([7, 8, 2], np.uint16), 6000), np.zeros(0, np.uint16)]
    data = rangecoder.write_segment([None, 12, 13], docs)
    names, back = rangecoder.read_segment(data)
    assert names == [None, 12, 13] and all((a == b).all() for a, b in zip(docs, back)) and len(data) < 6000
    for at in range(60, len(data), 97):
        with pytest.raises(ValueError):
            rangecoder.read_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        rangecoder.write_segment([1], [np.array([rangecoder.IDS])])
    monkeypatch.setattr(rangecoder, "BLOCK", 1000)  # one document over many blocks
    names, back = rangecoder.read_segment(rangecoder.write_segment([None, 12, 13], docs))
    assert all((a == b).all() for a, b in zip(docs, back))


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = [(k, "Some words " * (k % 7) + "été", "s", "en", 1, 1, "x") for k in range(50, 0, -1)] + ODD
    rows += [(77, f"the same id {k} <|endoftext|>" * 3, "s", "en", 1, 1, "x") for k in range(60)]  # a hot id
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    plain = lambda r: t.encode(r[1] or "", add_special_tokens=False).ids + [2]
    files = rangecoder.write_ids(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    assert max(r["count"] for r in files.selectExpr("bucket").groupBy("bucket").count().collect()) == 1
    got = rangecoder.read_ids(files, with_ids=True).orderBy("start").collect()
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    assert sorted((str(r[0]), plain(r)) for r in rows) == sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert rangecoder.read_ids(rangecoder.write_ids(spark.createDataFrame([], SCHEMA), path)).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = [(k, "x" * (k % 90), f"s{k % 5}", ["en", "fr"][k % 2], k % 90, 3, "x") for k in range(203)] + ODD
    assigned = hilbert.assign(spark.createDataFrame(rows, SCHEMA))
    got = assigned.collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by[r["shard"]].append(r)
    assert all([r["slot"] for r in own] == list(range(len(own))) for own in by.values())
    order = [r["curve"] for s in sorted(by) for r in by[s]]
    assert order == sorted(order)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert hilbert.run_statistics(assigned).count() == 16
    assert hilbert.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_are_of_whole_values(spark):
    long = "https://one-and-the-same-long-beginning.example/" * 3
    rows = [(k, "t", f"{long}{k:03d}", "en", 0.1 + 0.8 * (k % 2)) for k in range(64)] + [(99, "t", None, None, None), (100, "t", "", "zz" * 1000, float("nan"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double")
    got = {r["doc_id"]: r for r in hilbert.assign(docs, ("source", "score", "lang"), shards=4, bits=3).collect()}
    cells = [got[k]["cell0"] for k in range(64)]
    assert cells == sorted(cells) and max(Counter(cells).values()) <= 10 and len(set(cells)) == 8, "parts are equal whatever the values begin with"
    assert {got[k]["cell1"] < got[k + 1]["cell1"] for k in range(0, 64, 2)} == {True}, "0.1 and 0.9 are apart"
    assert (got[99]["cell0"], got[99]["cell1"], got[99]["cell2"]) == (0, 0, 0) and got[100]["cell1"] == max(r["cell1"] for r in got.values())


def test_readers_skip_shards(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, f"text {k}", f"s{rng.integers(40):02d}", ["de", "en", "fr"][rng.integers(3)], int(rng.integers(1000)), k % 3, "x") for k in range(4000)]
    docs = spark.createDataFrame(rows + ODD, SCHEMA)
    statistics = hilbert.write_shards(docs, str(tmp_path / "out")).collect()
    assert sum(r["rows"] for r in statistics) == len(rows + ODD) and len(statistics) == 16
    for column, at, low, high in (("source", 2, "s03", "s05"), ("n_chars", 4, 100, 160), ("lang", 3, "de", "de")):
        want = sorted(r[0] for r in rows + ODD if r[at] is not None and low <= r[at] <= high)
        assert sorted(r["doc_id"] for r in hilbert.read_shards(spark, str(tmp_path / "out"), {column: (low, high)}).collect()) == want
        kept = {r["shard"] for r in statistics if r["low"][column] <= high and r["high"][column] >= low}
        assert len(kept) <= 9, (column, kept)
        only = tmp_path / f"only-{column}"  # the other shards' rows aren't even there
        for part in ("statistics", "schema"):
            shutil.copytree(tmp_path / "out" / part, only / part)
        for k in kept:
            shutil.copytree(tmp_path / "out" / "shards" / f"shard={k}", only / "shards" / f"shard={k}")
        assert sorted(r["doc_id"] for r in hilbert.read_shards(spark, str(only), {column: (low, high)}).collect()) == want
    every = hilbert.read_shards(spark, str(tmp_path / "out"), {})
    assert sorted(map(str, every.collect())) == sorted(map(str, docs.collect()))
    hilbert.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert hilbert.read_shards(spark, str(tmp_path / "none"), {"lang": ("a", "b")}).count() == 0


def test_tool_calls(spark):
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
    chain = [(1, k, f"c{k}", "f", '{"n": 2.0, "tags": ["é"]}', f"c{k - 1}" if k else None) for k in range(20)]
    calls = chain + [(2, 1, "a", "f", '{"n": 0, "z": 1}', "b"), (2, 2, "b", "f", '{"n": 1}', "a"), (2, 3, "d", "f", "{", "a"), (3, 1, "a", "g", "{}", None), (3, 1, "a", "g", "{}", None), (3, 2, None, "f", '{"n": 1}', None), (None, 2, "q", "f", '{"n": 1, "n": 2}', None), (4, 1, "x", "f", '{"n": 1}', "nowhere"), (4, 2, "y", "f", None, "x")]
    results = [(1, 5, "c3", "late"), (1, 4, "c3", "early"), (1, 4, "c3", "early"), (9, 1, "none", None), (4, 3, "x", None), (3, 1, None, "z")]
    frame = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, after string")
    answers = spark.createDataFrame(results, "conv_id long, turn int, call_id string, content string")
    got = toolcalls.link(frame, answers, schemas).collect()
    assert len(got) == len(calls)
    by = {(r["conv_id"], r["call_id"]): r for r in got}
    assert [by[1, f"c{k}"]["depth"] for k in range(20)] == list(range(20))
    assert {by[2, c]["status"] for c in "abd"} == {"cycle"}
    assert by[1, "c3"]["n_results"] == 3 and json.loads(by[1, "c3"]["message"])["result"] == {"content": "early", "turn": 4}
    assert '"arguments":{"n":2,"tags":["é"]}' in by[1, "c3"]["message"]
    assert by[3, "a"]["errors"] == "$: no schema" and by[None, "q"]["errors"] == "$: repeated key" and by[4, "y"]["errors"] == "$: no arguments"
    assert by[2, "a"]["errors"] == "$.z: additionalProperties; $.n: minimum" or by[2, "a"]["errors"] == "$.n: minimum; $.z: additionalProperties"
    assert (by[4, "x"]["status"], by[4, "x"]["depth"], by[4, "y"]["depth"], by[1, "c4"]["status"]) == ("linked", 0, 1, "open")
    assert toolcalls.link(frame.limit(0), answers.limit(0), schemas).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_dedup_packing import plain_fingerprint

    rng = np.random.default_rng(1)
    text = lambda: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 5000, 20)) + "." for _ in range(5))
    bench = " ".join(f"q{i}" for i in range(12))
    base = [text() for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, base[0]) for k in range(5)] + [(200, base[1] + " " + bench), (201, base[2] + "\npassword = hunter2hunter2"), (202, "too short"), (203, None), (204, "a b c " * 40), (205, base[3]), (205, base[3])]
    extra = [(i, t, "en", None if i == 7 else "src", None, "clash", 1) for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, removed string, row int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert ids("quality_rules") == sorted([*range(30), *range(100, 105), 200, 201, 205, 205])
    least = {}
    for i, t in rows:
        if i in ids("quality_rules"):
            least.setdefault(plain_fingerprint(t), []).append(i)
    assert set(ids("near_dedup")) <= {min(x) for x in least.values()} and len(set(ids("near_dedup"))) == len(ids("near_dedup"))
    assert 200 not in ids("decontamination") and set(ids("near_dedup")) - set(ids("decontamination")) <= {200}
    assert ids("secret_masking") == ids("decontamination")
    if 201 in ids("secret_masking"):
        assert next(r["text"] for r in seen["secret_masking"] if r["doc_id"] == 201).endswith("\n[SECRET]")
    assert sorted({r["doc_id"] for r in seen["best_fit_packing"]}) == ids("secret_masking")
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r[:5] for r in again) == sorted(r[:5] for r in seen["best_fit_packing"])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_stages_keep_odd_rows_in_shape(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(ODD, SCHEMA)
    counts = {name: stage(spark, docs, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    assert counts["decontamination"] == counts["secret_masking"] == len(ODD) and counts["near_dedup"] == 4
    assert counts["quality_rules"] == 0, "short, empty or one repeated phrase"
    assert simhash.keep_one(docs).where("doc_id is null").count() == 1
