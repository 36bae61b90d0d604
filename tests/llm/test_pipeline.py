"""The pipeline against its stages done by brute force."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import langid, pii, units
from nearfield.llm.queries import pseudonym_key
from tests.llm.test_operators import brute_classes, check_packing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tuple(sorted(langid.fit(docs, F.lit(True)).items()))
    left = {r["doc_id"]: r for r in docs.collect()}
    left = {k: r for k, r in left.items() if (m := langid.classify(r["text"], model))[0] != "und" and m[1] >= langid.MIN_MARGIN}
    assert len(left) >= 0.97 * docs.count()
    by = defaultdict(list)
    for k, r in left.items():
        by[r["text"]].append(k)
    left = {max(v): left[max(v)] for v in by.values()}
    classes = brute_classes([(k, r["text"]) for k, r in left.items()])
    left = {k for k, c in classes.items() if k == c}
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs.where(F.col("doc_id").isin(list(left))), pseudonym_key(spark)).collect()}
    lib = units.library(P.path("word_bpe_49k.json"))
    want = {}
    for k, t in texts.items():
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        for p, a in enumerate(range(0, n, 4096)):
            want[k, p] = min(4096, n - a)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): r["length"] for r in got} == want
    check_packing(got, 4096)


def test_copies_go_by_row_and_not_by_id(spark, sf, tmp_path):
    words = [f"w{k * 7919 % 997}" for k in range(200)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (20, 70)]
    schema = "doc_id long, text string"

    def run(stage, rows):
        made = spark.createDataFrame(rows, schema)
        made.write.mode("overwrite").parquet(f"{tmp_path}/t")
        results = [sorted(map(tuple, stage(spark, df, sf).collect()), key=repr) for df in (made, spark.read.parquet(f"{tmp_path}/t"))]
        assert results[0] == results[1]
        return results[0]

    exact, close = corpus_pipeline.exact_copies, corpus_pipeline.near_copies
    assert run(exact, [(5, "alpha"), (5, "delta"), (9, "alpha")]) == [(5, "delta"), (9, "alpha")]
    assert run(exact, [(5, "alpha"), (5, "alpha"), (None, "beta"), (None, "beta"), (None, "alpha")]) == [(5, "alpha"), (None, "beta")]
    assert run(close, [(5, near[0]), (5, "one of a kind"), (9, near[1])]) == sorted([(5, near[0]), (5, "one of a kind")])
    assert run(close, [(None, near[0]), (7, near[1]), (None, near[1])]) == [(7, near[1])]
    assert len(run(close, [(None, near[0]), (None, near[1])])) == 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_input(spark, sf, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, length int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "one two", None, "s", 7, 1), (4, "one two", "en", None, 7, None), (5, "x " * 9000, "fr", "s", 1, 1), (5, "x " * 9000, "fr", "s", 1, 1)]
    for data in ([], rows):
        out = stage(spark, spark.createDataFrame(data, schema), sf)
        assert name == "packing" or out.columns == schema.replace(",", "").split()[::2]
        assert (out.count() > 0) == bool(data)
