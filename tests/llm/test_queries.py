"""The operators' queries against their SQL, and the pipeline, over the smallest tables."""

import os
import sys

import pytest
from oracle import both

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_sql(spark):
    from typeloom.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        ours, theirs = both(spark, QUERIES[name], sql, SF)
        assert ours == theirs, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and rows


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over a small corpus with nulls, empty texts, repeated rows, clashing names, copies and leaks."""
    from test_operators import PROSE, brute_components, brute_leaks, brute_mix, in_order

    import corpus_pipeline
    from typeloom.llm import quality, token_order

    fine = [" ".join(f"word{(i * 31 + k * 7) % 400}" for k in range(90 + 5 * i)) for i in range(25)]
    item = " ".join(f"secret{k}" for k in range(20))
    texts = [*fine, *PROSE, fine[0] + " tail", fine[0], fine[3].upper(), f"{fine[4]} {item}", f"{item.replace('secret5', 'other')} {' '.join(f'own{k}' for k in range(80))}", "too short", "", None, "\n".join(["BUY NOW!! ### $$$ | HOME"] * 30)]
    rows = [(i if i != 30 else None, t, "en", ["a", "b", None][i % 3], len(t or ""), 1, 2, 3, "x", 4) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id int, id int, place int, doc string, position int"
    for name, df in {"documents": spark.createDataFrame(rows, schema), "labels": spark.createDataFrame([(k, 1, 0) for k in range(8)] + [(len(texts) - 1, 0, 0)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = quality.score(docs.coalesce(1), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in score.filter("kept").collect()}
    left = [r for r in rows if r[0] in good]
    comp = brute_components([(i, r[1]) for i, r in enumerate(left)])
    one = {}
    for i, r in enumerate(left):
        c = comp[i][1]
        if c not in one or (r[0] is None, r[0] or 0) < (one[c][0] is None, one[c][0] or 0):
            one[c] = r
    left = list(one.values())
    leaky = brute_leaks([(r[0], r[1]) for r in left], [(1, item)])
    left = [r for r in left if (r[0], 1) not in leaky]
    stages = dict(corpus_pipeline.STAGES)
    now = docs
    for name in ("quality", "near_duplicates", "decontaminate"):
        now = stages[name](spark, now, sf)
        assert now.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in now.collect()) == sorted((str(r[0]), r[1]) for r in left)
    assert leaky and len(left) > 20
    mixed = sorted((p, str(i)) for i, _, _, _, _, ps in brute_mix([(r[0], r[3], r[1]) for r in left]) for p in ps)
    corpus = stages["mix"](spark, now, sf)
    assert corpus.columns == docs.columns and sorted(str(r.doc_id) for r in corpus.collect()) == sorted(i for _, i in mixed)
    sequences = corpus_pipeline.run(spark, sf).collect()
    want = []
    for bucket in in_order(spark, corpus, token_order.BUCKET_BYTES).values():
        stream = [d for d, ids in bucket for _ in ids]
        for k in range(0, len(stream), token_order.LENGTH):
            own = stream[k : k + token_order.LENGTH]
            want.append((len(own), sorted(map(str, set(own)))))
    assert sorted((r.n_tokens, sorted(map(str, set(r.doc_ids)))) for r in sequences) == sorted(want)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0
