"""Registered queries on tables of a folder: against SQL, brute force or the library; columns that clash; a lost file."""

import glob
import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from rillflow.llm import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, quality, queries, sentencepiece_codec, toxicity
from rillflow.llm._store import write_sorted

from . import brute
from .test_operators import labelled, rows, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = c.execute(entry.oracle_sql()[name])
    same(entry.queries()[name](spark, SF), [d[0] for d in want.description], want.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    own, labels, _ = labelled(spark, 300)
    more = spark.createDataFrame([(None if i is None else i + 10_000, t, None) for i, t in rows()], own.schema)
    own.union(more).withColumn("score", own.doc_id * 0).withColumn("n_lines", own.doc_id).write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("a\nb", rows()[6][1]), ("c", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_plain_results_of_queries(spark, folder):
    own = texts(spark, folder)
    same(queries.op3_exact_dedup(spark, folder), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], brute.exact(own))
    same(queries.op5_substring_dedup(spark, folder), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substrings(own, 50))
    same(queries.op6_jaccard_join(spark, folder), ["doc_id", "n_shingles", "component_id"], brute.jaccard(own))
    got = queries.op8_decontamination(spark, folder)
    same(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute.leaks(own, [("a\nb", rows()[6][1]), ("c", None)]))
    assert got.filter("n_items = 1").first().items_sha256 == decontamination.sha(["a\nb"])
    assert queries.op4_sentencepiece(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("query,n,held", [(queries.op1_toxicity, 4, 2), (queries.op2_lm_scoring, 10, 0), (queries.op7_language_id, 3, 1), (queries.op9_quality, 5, 0)])
def test_learned_queries(spark, folder, query, n, held):
    got = query(spark, folder)
    want = sorted(str((i, i is None or zlib.crc32(str(i).encode()) % n == held)) for i, _ in texts(spark, folder))
    out = got.collect()
    assert sorted(str((r.doc_id, r.held_out)) for r in out) == want and dict(got.dtypes)["score"] == "double"
    if "predicted" in got.columns:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    if "lang_pred" in got.columns:
        assert {r.lang_pred for r in out} <= {"xx", "yy", "und"} and all((r.score == 0) == (r.lang_pred == "und") for r in out)


def test_clashing_columns_come_back(spark, folder):
    names = ["score", "n_lines", "n_words", "kept", "_k0", "_scan", "_letter", "_id", "_text", "perplexity", "items", "decoded", "lang_pred", "score_kept"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").selectExpr("*", *[f"'{x}' AS {x}" for x in names])
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    keep = ["doc_id", *names]
    done = {
        "score": [toxicity.score(docs, toxicity.Model(), keep), quality.score(docs, quality.Model(), keep), lm_scoring.score(docs, lm_scoring.fit(docs, 2), keep), language_id.predict(docs, None, keep)],
        "n_lines": [line_dedup.line_dedup(docs, keep=keep)], "items": [decontamination.decontaminate(docs, items, keep=keep)], "decoded": [sentencepiece_codec.encode_decode(docs, queries.tokenizer_path(), keep=tuple(keep))],
    }
    for result, frames in done.items():
        for df in frames:
            assert len(set(df.columns)) == len(df.columns) and df.count() == docs.count()
            back = next(c for c in (f"{result}_kept_kept", f"{result}_kept") if c in df.columns)
            assert df.select(back).distinct().collect()[0][0] == result
    assert exact_dedup.exact_dedup(docs).count() == docs.count()


def test_a_lost_file_is_an_error(spark):
    store = write_sorted(spark.range(1000).selectExpr("xxhash64(id) AS k", "id"), "lost")
    keys = np.array([r.k for r in spark.range(1000).selectExpr("xxhash64(id) AS k").collect()], dtype=np.int64).view(np.uint64)
    assert store.lookup(keys)[0].all() and not store.lookup(keys + np.uint64(1))[0].any()
    os.remove(glob.glob(f"{store.folder}/*.key.npy")[0])
    store.open._files.clear()
    with pytest.raises(FileNotFoundError):
        store.lookup(keys)


def test_filters_share_no_bits_with_shards():
    keys = [(0xABC << 52) | (zlib.crc32(str(i).encode()) << 16 | i % 65536) for i in range(20_000)]
    f = exact_dedup.CuckooFilter(len(keys))
    assert all(f.insert(k) for k in keys) and f.n * 4 < 4 * len(keys)
    assert sum(((0xABC << 52) | (zlib.crc32(f"x{i}".encode()) << 16)) in f for i in range(20_000)) < 40
