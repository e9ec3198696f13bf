"""Who votes for boilerplate: distinct documents of a host; in the pipeline, classes of near copies."""

import random

from millrace.llm import quality

SCHEMA = "doc_id long, text string, source string"


def test_different_documents_each_vote_for_a_line(spark):
    import corpus_pipeline

    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notes = sorted((f"All rights reserved {k}" for k in range(400)), key=lambda x: quality.line_key(x.encode()) % (1 << 64))
    low = notes[:2]  # the least line hashes of nearly all documents that hold them
    rows = [(k, f"{fresh(60)}\n{low[0]}\n{low[1]}", "h") for k in range(40)] + [(100 + k, fresh(60), "h") for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert out == {k: t.split("\n")[0] for k, t, _ in rows}


def test_large_group_of_near_copies_survives(spark):
    import corpus_pipeline

    rng = random.Random(2)
    fresh = lambda: [[f"w{rng.randrange(10**6)}" for _ in range(20)] for _ in range(6)]
    text = lambda lines: "\n".join(map(" ".join, lines))
    base, rows = fresh(), []
    for k in range(1000):
        own = [list(x) for x in base]
        own[rng.randrange(6)][rng.randrange(20)] = f"e{k}"
        rows.append((k, text(own), "h"))
    rows += [(2000 + k, text(fresh()), "h") for k in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(map(tuple, clean.collect())) == sorted(rows), "no line of theirs is boilerplate"
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, clean, "").collect()) == [0, *range(2000, 4000)]


def test_a_footer_goes_whatever_its_hash(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notes = sorted((f"All rights reserved {k}" for k in range(400)), key=lambda x: quality.line_key(x.encode()))
    for footer in (notes[0], notes[200], notes[-1]):
        rows = [(k, "\n".join([fresh(20), fresh(20), fresh(20), footer]), "h") for k in range(200)] + [(900, f"{footer}\n{fresh(60)}", "other")]
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {**{k: (4, True) for k in range(200)}, 900: (0, True)}


def test_limits_and_exact_copies(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    at, over = "just at the limit", "one above it"
    rows = [(k, "\n".join([fresh(60), *[at] * (k < 10), *[over] * (k < 11)]), None) for k in range(40)]
    rows += [(100 + k, rows[0][1], None) for k in range(30)]  # copies of one text are one document
    rows += [(200, "\n".join([over] * 30 + [fresh(22)]), None), (201, "\n".join([over] * 30 + [fresh(23)]), None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), min_docs=12).collect()}
    assert {r["n_removed"] for r in got.values() if r["doc_id"] < 200} == {0, 3}
    assert [got[k]["n_removed"] for k in (0, 10, 11, 105)] == [3, 3, 0, 3]
    assert (got[200]["base_failed"], got[200]["kept"]) == (True, False)
    many = [(k, f"{fresh(60)}\n{over}", "h") for k in range(30)]
    docs = spark.createDataFrame(many, SCHEMA)
    assert {r["n_removed"] for r in quality.judge(docs, share=1.0).collect()} == {0}
    assert {r["n_removed"] for r in quality.judge(docs, share=1.0, max_docs=20).collect()} == {3}, "no host is too large for the ceiling"


def test_one_text_on_two_hosts(spark, monkeypatch):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    note = "Printed in the usual place"
    rows = [(k, f"{fresh(60)}\n{note}", "h") for k in range(20)]
    twin = f"{fresh(60)}\n{note}"
    short = "\n".join([" ".join(f"x{j}" for j in range(45)), note + " " + " ".join(f"y{j}" for j in range(10))])
    rows += [(50, twin, "h"), (50, twin, "lone"), (51, short, "lone"), (51, short, "lone")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((k, t.removesuffix("\n" + note) if h == "h" else t, h) for k, t, h in rows)
    for few in (quality.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality, "BROADCAST_LINES", few)
        monkeypatch.setattr("millrace.llm.common.BROADCAST_KEYS", few)
        assert sorted(map(tuple, quality.apply(docs).collect())) == want
        clashing = quality.apply(docs.selectExpr("*", "'x' AS __removed", "'y' AS removed", "'z' AS row"))
        assert sorted(r[:3] for r in map(tuple, clashing.collect())) == want and clashing.columns[-3:] == ["__removed", "removed", "row"]
