"""The queries with SQL against it on the smallest tables, and the pipeline against its parts."""

import hashlib
import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from recollect.llm import bpe, decontaminate, language, queries, secret_scan, simhash
from tests.test_queries import SF, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(queries.SQL[name])
    assert got == rows([d[0] for d in found.description], found.fetchall())


def after_all_stages(spark, docs, bench):
    """doc_id and tokens of what the stages leave of docs (list of rows with unique ids), in plain Python over what the operators say of each stage's input."""
    by_id, schema = {r.doc_id: r for r in docs}, "doc_id long, text string, lang string"
    table = lambda kept: spark.createDataFrame([(k, by_id[k].text, by_id[k].lang) for k in kept], schema)
    least = language.fitted(table(by_id)).least_familiar
    kept = [r.doc_id for r in language.identify(table(by_id)).collect() if r.lang_pred != "und" and r.familiar >= least]
    kept = sorted({r.kept_id for r in simhash.similar_groups(table(kept)).collect()})
    kept = sorted(r.doc_id for r in decontaminate.contamination(table(kept), bench).collect() if not r.contaminated)
    network, tree = secret_scan.trained(), bpe.tokenizer(*_bpe())
    out = {}
    for k in kept:
        text, end, parts = by_id[k].text, 0, []
        [(_, spans)] = secret_scan.scan_texts([text], [text.encode()], [True], network)
        for a, b, kind, _ in spans:
            if a >= end:
                parts += [text[end:a], f"[SECRET {secret_scan.KINDS[kind]}]"]
            end = max(end, b)
        out[k] = tree.core.encode_ordinary("".join([*parts, text[end:]]))
    return out


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = after_all_stages(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == expected and len(got) == len(expected) > 100
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in got)


@pytest.fixture
def odd_documents(spark, tmp_path):
    """Documents with nulls, blanks, junk, a long text, repeated rows and ids, and columns with names that operators use."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows = docs * 2 + [(docs[0][0], docs[1][1] + " of another text", "en"), (None, docs[2][1], "en"), (None, None, None), (None, docs[3][1] + " and more words here", "en")]
    rows += [(10_000, None, None), (10_001, "", "en"), (10_002, " \n ", None), (10_003, "\u16a0\u16a1 " * 99, None), (10_004, " ".join(t for _, t, _ in docs[5:60]) * 3, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id string, row_hash string, kept_id string, fine string, gram string, score string, n int"
    made = spark.createDataFrame([(*r, "s", len(r[1] or ""), "a", "b", "c", "d", "e", "f", k % 7) for k, r in enumerate(rows)], schema)
    made.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_documents):
    docs = spark.read.parquet(f"{odd_documents}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_documents)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), odd_documents).count() == 0, name
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, odd_documents).collect()]
    assert len(kept) == len(set(kept))  # of repeated rows one stays
    texts = {t for _, t in kept if t and t.split()}
    assert len(texts) > 50 and sum(t is None or not t.split() for _, t in kept) == 1  # and of blank texts
    got = corpus_pipeline.run(spark, odd_documents).collect()
    assert len(got) > 50 and not {r.doc_id for r in got} & {10_000, 10_001, 10_002, 10_003}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
