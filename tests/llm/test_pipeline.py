"""The stages of the corpus pipeline, each against a plain version on its own input."""

import re

import corpus_pipeline
from terrace.llm import pieces
from terrace.llm.queries import piece_model
from test_token_groups import components


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
    rows = {k: [r.asDict() for r in v.collect()] for k, v in seen.items()}
    columns = seen["start"].columns
    assert all(seen[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    kept = [(r["doc_id"], r["text"]) for r in rows["quality_rules"]]
    assert 0.8 * len(rows["start"]) < len(kept) < len(rows["start"])
    assert {r["doc_id"] for r in rows["near_duplicates"]} == {c for n, c in components(kept, 5, 80).values() if n}
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) for r in rows["secret_scan"])
    assert all(r["n_chars"] == len(r["text"]) for r in rows["secret_scan"])
    mixed = {r["doc_id"]: r["text"] for r in rows["source_mix"]}
    assert mixed.items() <= {r["doc_id"]: r["text"] for r in rows["secret_scan"]}.items()
    back = pieces.decode(docs, piece_model()).collect()
    assert len(back) == len(mixed) and all(r.decoded == r.text == mixed[r.doc_id] for r in back)
