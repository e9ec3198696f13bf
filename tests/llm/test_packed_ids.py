"""The pipeline's output holds what the packed sequences are built from."""

import numpy as np
from test_dedup_packing import BYTE, SCHEMA
from tokenizers import Tokenizer


def test_pipeline_output_builds_the_sequences(spark):
    import corpus_pipeline

    texts = {k: f"text {k} " * (k * 97 % 1500 + 1) for k in range(30)}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], SCHEMA)
    library = Tokenizer.from_file(BYTE)
    sequences, pieces = {}, {k: [] for k in texts}
    for r in corpus_pipeline.best_fit_packing(spark, docs, "").collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        row = sequences.setdefault(r["sequence_id"], {})
        for k, x in enumerate(ids):
            assert r["offset"] + k not in row, "one id a place"
            row[r["offset"] + k] = x
        pieces[r["doc_id"]].append((r["start"], ids))
    assert all(sorted(row) == list(range(len(row))) and len(row) <= 2048 for row in sequences.values())
    for k, t in texts.items():
        assert [x for _, ids in sorted(pieces[k]) for x in ids] == [*library.encode(t, add_special_tokens=False).ids, 0]
