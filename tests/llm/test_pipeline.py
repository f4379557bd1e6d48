"""The stages on the smallest tables, each against a brute-force version of what it decides."""

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_operators import brute_components, brute_lines, brute_rules, check_packing, reference_ids
from tidewell.llm import secrets
from tidewell.session import materialize


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, done = docs.columns, [docs]
    for name, stage in P.STAGES:
        done.append(materialize(stage(spark, done[-1], SF), "test-stage"))
    assert all(d.columns == columns for d in done[:-1])
    raw, clean, lean, single, safe = (texts(d) for d in done[:-1])
    passes = {d for d, t in raw.items() for n, _, _, _, rep in [brute_rules(t)] if n >= 50 and 100 * rep <= 50 * n}
    assert set(clean) == passes
    ids = sorted(clean)
    verdict = brute_lines([clean[i] for i in ids])
    assert sorted(lean) == [ids[k] for k in range(len(ids)) if not verdict[k][0] or verdict[k][1]]
    ids = sorted(lean)
    assert sorted(single) == [ids[k] for k, _, c in brute_components([lean[i] for i in ids], 5, 80) if k == c]
    assert set(safe) == set(single) and not any(secrets.base_spans(t) for t in safe.values())
    assert all(safe[i] == single[i] for i in single if not secrets.base_spans(single[i]))
    ids = sorted(safe)
    check_packing(done[-1].collect(), dict(zip(ids, reference_ids([safe[i] for i in ids]))), 1024)
