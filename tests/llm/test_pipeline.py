"""Each stage of the pipeline, and all in turn, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from rillflow.llm import jaccard_join, quality
from rillflow.llm.queries import tokenizer_path

from . import brute
from .test_operators import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    r = random.Random(9)
    base = " ".join(f"w{i}" for i in range(60))
    near = [(200 + i, base.replace(f"w{r.randrange(60)} ", f"v{i} ")) for i in range(4)]
    more = [(None, base), (None, base), (300, base), (300, base), (301, "a text of its own under an id that two rows share"), (301, base + " end"), (None, "some words that only rows without id have"), (None, "some words that only rows without id have")]
    return [(i, t, "xx", "s", len(t or "")) for i, t in rows() + near + more]


def rank(i):
    return (i is None, i or 0)


def one_of_each(own):
    """For each group, the rows that may stay; rows without a word by themselves."""
    found = brute.jaccard([(k, x[1]) for k, x in enumerate(own)], 5, 80, 100)
    groups = {}
    for k, n, c in found:
        groups.setdefault(c if n else ("none", k), []).append(own[k])
    return [{x for x in g if rank(x[0]) == min(rank(y[0]) for y in g)} for g in groups.values()]


def check_copies(got, own):
    groups, left = one_of_each(own), Counter(map(tuple, got))
    assert left.total() == len(groups)
    for g in sorted(groups, key=len):
        hit = [x for x in g if left[x]]
        assert hit, g
        left[hit[0]] -= 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    own = made()
    spark.createDataFrame(own, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    ids = sorted({x[0] for x in own if x[0] is not None})
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in ids] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    taken = next(x[1] for x in own if x[0] == 7).split()
    spark.createDataFrame([("i1", None), ("i2", " ".join(taken[5:40]))], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def load(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain_quality(spark, folder):
    docs = load(spark, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [tuple(r)[:5] for r in quality.score(docs, model, docs.columns).collect() if r.score >= 0.3]


def plain_lines(own):
    out = []
    for x, (i, t, n, keep) in zip(own, brute.all_lines([x[:2] for x in own]), strict=True):
        if keep or not n:
            out.append(x if len(keep) == n else (i, "\n".join(keep), *x[2:4], len("\n".join(keep))))
    return out


def plain_leaks(spark, folder, own):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    return [x for x, y in zip(own, brute.leaks([x[:2] for x in own], items), strict=True) if not y[-1]]


def plain_tokens(own):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    ids = [sp.encode(x[1] or "", add_bos=True, add_eos=True) for x in own]
    return Counter((x[0], np.array(k, "<u4").tobytes(), len(k), sp.decode(k) == (x[1] or "")) for x, k in zip(own, ids, strict=True))


def rows_of(df):
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


def test_quality_stage(spark, folder):
    assert rows_of(corpus_pipeline.keep_quality(spark, load(spark, folder), folder)) == Counter(plain_quality(spark, folder))


def test_line_stage(spark, folder):
    assert rows_of(corpus_pipeline.drop_lines(spark, load(spark, folder), folder)) == Counter(plain_lines(made()))


def test_near_copies_keep_one_row_of_each_group(spark, folder):
    check_copies(corpus_pipeline.drop_near_copies(spark, load(spark, folder), folder).collect(), made())


def test_common_phrases_make_no_groups_of_near_copies(spark, folder, monkeypatch):
    own, groups, table = [], [], jaccard_join.table
    for i in range(60):  # each phrase is in 15 texts, more than are counted by pairs here, and most of a text is its own
        phrases = [" ".join(f"p{p}w{j}" for j in range(8)) for p in range(i % 4, 40, 4)]
        own.append((i, " ".join([*(f"own{i}x{j}" for j in range(60)), *phrases]), "xx", "s", 1))
    own.append((60, own[7][1].replace("own7x3 ", "other "), "xx", "s", 1))
    monkeypatch.setattr(jaccard_join, "COUNTED", 10)
    monkeypatch.setattr(jaccard_join, "table", lambda df, what: groups.append(sorted(x[0] for x in table(df, what).groupBy("region").count().select("count").collect())) or table(df, what) if what == "groups" else table(df, what))
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(own, SCHEMA).repartition(30), folder)
    assert sorted(tuple(x) for x in got.collect()) == own[:60]
    assert groups == [[2]]


def test_leaks_and_tokens(spark, folder):
    docs = load(spark, folder)
    want = plain_leaks(spark, folder, made())
    assert len(want) < len(made())
    assert rows_of(corpus_pipeline.drop_leaks(spark, docs, folder)) == Counter(want)
    assert rows_of(corpus_pipeline.encode(spark, docs, folder)) == plain_tokens(made())


def test_run(spark, folder, tmp_path):
    own = plain_lines(plain_quality(spark, folder))
    groups = one_of_each(own)
    want = plain_tokens(plain_leaks(spark, folder, [min(g) if len(g) > 1 else next(iter(g)) for g in groups]))
    got = rows_of(corpus_pipeline.run(spark, folder))
    assert got.total() == want.total() and Counter(k[0] for k in got.elements()) == Counter(k[0] for k in want.elements())
    docs = load(spark, folder)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
