"""The pipeline's fact is checked as it is stored, not built a second time."""

from millrace.operators import star
from millrace.plans.runner import Params, Pipeline
from millrace.sources.retail import retail
from millrace.sources.store import TableStore


def test_fact_is_checked_as_stored(spark, tmp_path, monkeypatch):
    seen, real = [], star.validate_fact
    monkeypatch.setattr(star, "validate_fact", lambda fact, base: seen.append(fact.inputFiles()) or real(fact, base))
    report = Pipeline(TableStore(spark, f"file://{tmp_path}/lake"), retail(spark, "/root/testdata/sf0.001"), Params(as_of="2001-01-01")).dimensional()
    assert seen[0] and all("/gold/fact_sales/" in f for f in seen[0])
    assert report["check"]["is_valid"] and report["check"]["fact_rows"] == report["rows"]["gold/fact_sales"]
