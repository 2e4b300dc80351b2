"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rillflow.llm import decontamination, exact_dedup, jaccard_join, language_id, line_dedup, lm_scoring, quality, sentencepiece_codec, substring_dedup, toxicity
from rillflow.llm._spark import components
from rillflow.llm.queries import op2_lm_scoring, op10_line_dedup, tokenizer_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, n_words int, kept string, score double, key long, _b int, words string"
WORDS = "the of and to in is that for it on with as was at by an be this from or ouen thnt erin heon Atly tion über schön été niño".split()


def rows():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "x", "y", "zq"]) + str(r.randrange(40)) for _ in range(n))
    passage, base = say(70), say(90)
    near = base.split()
    near[40] = "changed"
    lines = [say(8) for _ in range(6)]
    out = [
        (1, None), (2, ""), (3, " \t\n\u000b "), (4, "one"), (5, "One"), (6, "one two"), (7, base), (8, " ".join(near)), (9, base), (9, base),
        (10, say(5) + " " + passage + " " + say(9)), (11, passage), (12, say(30) + " " + passage), (None, passage + " end"), (None, None), (13, "\n".join(lines)),
        (14, "\n".join([lines[0], lines[1] + "!", lines[2][:-2] + "??", "short", "short", lines[3]])), (15, base.upper()), (16, "日本語 🤖 ▁ \u0000 a b"), (17, "x" * 9000 + " " + passage * 20), (-5, passage),
    ]
    return out + [(100 + i, say(r.randrange(1, 120))) for i in range(60)]


ITEMS = [("i1", None), ("i2", ""), (None, "ouen9 thnt1"), ("i3", "One, two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, 1, "k", 0.5, 7, 3, "w") for i, t in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, columns, want):
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_exact_dedup(docs, none):
    same(exact_dedup.exact_dedup(docs), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], brute.exact(rows()))
    assert exact_dedup.exact_dedup(none).count() == 0


def test_cuckoo_filter_grows_and_forgets():
    index = exact_dedup.CuckooIndex(8)
    digests = [random.Random(i).getrandbits(64) for i in range(3000)]
    for d in digests:
        index.insert(d, "c", d)
    assert index.resizes and all(index.find(d, "c") for d in digests) and index.find(digests[0], "other") is None
    for d in digests[:2000]:
        assert index.delete(d, "c")
    assert not any(index.find(d, "c") for d in digests[:2000]) and all(index.find(d, "c") for d in digests[2000:])


def test_substring_dedup(docs, none):
    out = substring_dedup.substring_dedup(docs, size=50)
    got = out.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS s")
    same(got, got.columns, brute.substrings(rows(), 50))
    assert substring_dedup.substring_dedup(none).count() == 0


def test_matching_statistics():
    r = np.random.default_rng(2)
    seqs = [r.integers(1, 4, n) for n in (30, 1, 17, 44)]
    index = substring_dedup.FMIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), 5, 12)
    queries = [r.integers(0, 5, 40), r.integers(1, 4, 25)]
    text = [",".join(map(str, s)) + "," for s in seqs]
    for q, pos, length, lo, hi in index.matching(queries, 12):
        for i, p, n, a, b in zip(q, pos, length, lo, hi, strict=True):
            best = max(n_ for n_ in range(13) if p + n_ <= len(queries[i]) and any(("," + t).find("," + ",".join(map(str, queries[i][p : p + n_])) + ("," if n_ else "")) >= 0 for t in text))
            assert n == best and (n == 0 or b > a)


@pytest.mark.parametrize("sizes", [{}, {"COUNTED": 2, "REGION": 3, "LEAF": 2, "PIVOTS": 2, "CELL": 3}, {"REGION": 4, "CUTS": 0.0}])
def test_jaccard_join(docs, none, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(jaccard_join, k, v)
    same(jaccard_join.jaccard_components(docs), ["doc_id", "n_shingles", "component_id"], brute.jaccard(rows()))
    if not sizes:
        assert jaccard_join.jaccard_components(none).count() == 0


def dense(seed, n, kinds=1, most=9):
    r, made = random.Random(seed), []
    for i in range(n):
        w = [f"w{i % kinds}x{j}" for j in range(120)]
        for _ in range(r.randrange(0, most)):
            w[r.randrange(120)] = f"v{r.randrange(1000)}"
        made.append((i, " ".join(w)))
    return made


@pytest.mark.parametrize("sizes", [{}, {"REGION": 20, "LEAF": 4, "PIVOTS": 3, "CELL": 16}, {"REGION": 20, "CUTS": 0.2, "CELL": 16}])
def test_jaccard_join_of_dense_groups(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(jaccard_join, k, v)
    made = dense(1, 150, 3)
    same(jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id"], brute.jaccard(made))


def test_shingles_that_many_share_make_no_groups(spark, monkeypatch):
    r, made, groups, table = random.Random(3), [], [], jaccard_join.table
    for i in range(60):  # each phrase is in some 15 texts, more than are counted by pairs here, and most of a text is its own
        phrases = [" ".join(f"p{p}w{j}" for j in range(6)) for p in r.sample(range(40), 10)]
        made.append((i, " ".join([*(f"own{i}x{j}" for j in range(60)), *phrases])))
    made.append((60, made[7][1].replace("own7x3 ", "other ")))
    monkeypatch.setattr(jaccard_join, "COUNTED", 10)
    monkeypatch.setattr(jaccard_join, "table", lambda df, what: groups.append(table(df, what)) or groups[-1] if what == "groups" else table(df, what))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(30)  # a task sees a shingle once or twice
    same(jaccard_join.jaccard_components(docs), ["doc_id", "n_shingles", "component_id"], brute.jaccard(made))
    assert groups[0].count() == 2


@pytest.mark.parametrize("n", [1, 12, 4000])
def test_cells_of_shingles_are_packed_whole(n):
    h = np.random.default_rng(n).integers(0, 1 << 64, 5000, dtype=np.uint64)
    cells = jaccard_join.cells_of(np.concatenate((h, h[:700], h[:3])), n)
    rows = jaccard_join.pack_cells(cells, n).to_pylist()
    assert [x["_b"] << jaccard_join.CELL_BITS | c for x in rows for c in jaccard_join.unpack_cells([x["blob"]]).tolist()] == sorted(cells.tolist())
    assert jaccard_join.unpack_cells([rows[0]["blob"]] * 2).tolist() == sorted(jaccard_join.unpack_cells([rows[0]["blob"]]).tolist() * 2)


@pytest.mark.parametrize("leaf,pivots,cuts,cell", [(24, 8, 0.8, 400), (2, 3, 0.95, 7), (2, 2, 0.0, 5), (4, 5, 0.9, 400)])
def test_a_region_joins_what_all_pairs_do(monkeypatch, leaf, pivots, cuts, cell):
    for k, v in (("LEAF", leaf), ("PIVOTS", pivots), ("CUTS", cuts), ("CELL", cell)):
        monkeypatch.setattr(jaccard_join, k, v)
    r, limit = random.Random(leaf), jaccard_join.Threshold(80, 100)
    sets = [np.unique(np.array([(w if r.random() > 0.06 else r.randrange(1 << 20)) + 100_000 * (i % 4) for w in range(40)], np.uint64)) for i in range(90)]
    mine = np.array([r.random() < 0.7 for _ in sets])
    found = jaccard_join.join_region(sets, mine, limit)
    assert all(limit.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])) for i, j, _ in found)

    def parts(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = (next(k for k in range(len(sets)) if k == root[x]) if root[x] == x else root[x] for x in (i, j))
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    every = [(i, j) for i in range(len(sets)) for j in range(i) if limit.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert parts([(i, j) for i, j, _ in found if mine[i] or mine[j]] + [x for x in every if not (mine[x[0]] or mine[x[1]])]) == parts(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[300] == 200


def test_decontamination(spark, docs, none):
    taken = next(t for i, t in rows() if i == 7).split()
    items = [*ITEMS, ("long", " ".join(taken[5:25])), ("twice", " ".join(taken[10:40])), ("other", "nowhere to be found " * 8)]
    table = spark.createDataFrame(items, "item_id string, text string")
    out = decontamination.decontaminate(docs, table)
    got = out.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) AS long) n", "sha2(array_join(items, ','), 256) s", "contaminated")
    same(got, got.columns, brute.leaks(rows(), [("" if i is None else i, t) for i, t in items]))
    assert decontamination.decontaminate(none, table).count() == 0
    assert decontamination.decontaminate(docs, table.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scoring(docs, none, order):
    own = [t for _, t in rows()]
    model = lm_scoring.fit(docs.filter("doc_id % 2 = 0"), order)
    want = brute.kneser_ney([t for i, t in rows() if i is not None and i % 2 == 0], own, order)
    got = sorted(tuple(r) for r in lm_scoring.score(docs, model, ["doc_id"]).select("n_tokens", "n_known", "base_score", "score").collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-8)
    assert lm_scoring.score(docs, lm_scoring.fit(none, order), ["doc_id"]).count() == len(own)


def test_lm_scoring_is_registered_with_trigrams(spark, tmp_path):
    own = [(i, t) for i, t in rows() if i is not None]
    spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in own}
    assert any(held.values())
    want = brute.kneser_ney([t for i, t in own if not held[i]], [t for _, t in own], 3)
    got = sorted(tuple(r) for r in op2_lm_scoring(spark, str(tmp_path)).select("doc_id", "held_out", "n_tokens", "score").collect())
    for a, b in zip(got, sorted((i, held[i], w[0], w[3]) for (i, _), w in zip(own, want)), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3], b[3], rtol=1e-8)


def test_tables_of_many_buckets_are_searched_together(tmp_path):
    r, tables, want = np.random.default_rng(8), [], []
    for b, n in enumerate((0, 1, 5000, 40, 0, 900)):
        keys = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        values = [r.integers(1, 700, len(keys)), r.integers(0, 3, len(keys))]  # more kinds than have codes
        tables.append(lm_scoring.table_bytes(keys, *values))
        want += [(int(k), b, int(x), int(y)) for k, x, y in zip(keys, *values, strict=True)]
    lm_scoring.join_tables(tables, f"{tmp_path}/shelf.npy")
    keys, which, x, y = (np.array([w[i] for w in want], dtype=np.uint64 if i == 0 else np.int64) for i in range(4))
    data = np.load(f"{tmp_path}/shelf.npy", mmap_mode="r")
    assert (lm_scoring.lookup(np.asarray(data), keys, which) == np.stack((x, y), axis=1)).all()
    assert not lm_scoring.lookup(np.asarray(data), keys, (which + 1) % 6).any()


def test_the_files_a_piece_reads_do_not_grow_with_the_buckets(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    texts = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows()])], names=["text"])
    found = []
    for n in ("4", "70"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            model = lm_scoring.fit(docs)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        h, start, m = lm_scoring.tokens(texts, 3)
        found.append(model.probabilities(h, lm_scoring.windows(h, start, m)))
        assert len(model.open._files) <= 6 * 16
    assert all((x == y).all() for x, y in zip(*found, strict=True))


def test_ngrams_are_packed_whole():
    r = np.random.default_rng(1)
    for k, n in ((1, 40), (3, 5000), (5, 30_000)):  # of 30,000 words five take more than 64 bits
        h, at = r.integers(0, 1 << 63, 60 if k < 5 else 30_000, dtype=np.uint64), r.integers(k - 1, 60 if k < 5 else 30_000, n)
        times = r.integers(1, 9, n)
        for t in (None, times):
            blobs = lm_scoring.deal(h, at, k, 3, t).column(1).to_pylist()
            cols, c = lm_scoring.unpack_grams(blobs, k)
            want = Counter()
            for a, x in zip(at.tolist(), times.tolist() if t is not None else [1] * n):
                want[tuple(h[a - k + 1 : a + 1].tolist())] += x
            assert dict(zip(zip(*(x.tolist() for x in cols)), c.tolist(), strict=True)) == want


def test_sentencepiece(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = []
    for i, t in rows():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sentencepiece_codec.sha(np.array(ids, "<u4").tobytes()), brute.sha(sp.decode(ids))))
    same(sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, tokenizer_path())), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    assert sentencepiece_codec.encode_decode(none, tokenizer_path()).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs).selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(kept, ''), 256) s")
    same(out, out.columns, brute.lines(rows()))
    assert line_dedup.line_dedup(none).count() == 0


SHORT = [(1, "Les.\nAll rights reserved.\n\n  \nLes. "), (2, "\n  \nLes.\nnew\nLes.\nAll rights reserved."), (3, "new"), (None, "Les.\nown"), (0, "new\nown\nLes?"), (4, "twenty-three characters\ntwenty-three characters"), (5, "twenty-three characterz\n24 characters, no more!!\n24 characters, no more!?")]


def test_short_lines_of_the_query_and_the_stage(spark, tmp_path):
    own = rows() + [(None if i is None else i + 500, t) for i, t in SHORT]
    df = spark.createDataFrame([(i, t, "l", "s", -1) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.all_lines(own)
    assert sum(n - len(k) for _, _, n, k in want) > sum(x[2] for x in brute.lines(own))
    same(op10_line_dedup(spark, str(tmp_path)), ["doc_id", "n_lines", "n_removed", "kept_sha256"], [(i, n, n - len(k), brute.sha("\n".join(k)) if t is not None else None) for i, t, n, k in want])
    stay = [(i, t if len(k) == n else "\n".join(k), -1 if len(k) == n else len("\n".join(k))) for i, t, n, k in want if k or not n]
    same(corpus_pipeline.drop_lines(spark, df, str(tmp_path)), ["doc_id", "text", "n_chars"], stay)


def test_edit_distance():
    r = random.Random(3)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(13)))
        b = "".join(r.choice("ab") for _ in range(r.randrange(13)))
        for most in (1, 2, 3):
            near = brute.edit_distance(a, b) <= most
            assert line_dedup.within(a, b, most) == near
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            if near and len(y) > most:
                cut = line_dedup.parts(len(y), most)
                assert any(x[s : s + n] == y[cut[i][0] :][:n] for i, s, n in line_dedup.probes(len(x), len(y), most))


def labelled(spark, n=400):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad, w = r.random() < 0.4, [r.choice(WORDS) for _ in range(r.randrange(5, 60))]
        if bad:
            w[r.randrange(len(w))] = "scumword"
        junk = r.random() < 0.4
        docs.append((i, " ".join(x + "###" for x in w) if junk else " ".join(w), "xx" if junk else "yy"))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers(spark, docs, none):
    own, labels, want = labelled(spark)
    fit_on = labels.filter("doc_id < 300 or doc_id is null or quality is null")
    for module, k in ((toxicity, 2), (quality, 1)):
        model = module.fit(own, fit_on)
        got = {r.doc_id: r.score for r in module.score(own, model, ["doc_id"]).collect()}
        right = [(got[w[0]] >= 0.3) == w[k] for w in want[300:]]
        assert np.mean(right) > 0.9, module
        every = module.score(docs, model, ["doc_id", "n_words"]).collect()
        assert len(every) == len(rows()) and all(0 <= r.score <= 1 for r in every)
        assert module.score(none, model, ["doc_id"]).count() == 0
        assert module.score(own, module.fit(own, labels.limit(0)), ["doc_id"]).count() == len(want)
    model = language_id.fit(own.filter("doc_id < 300"))
    got = {r.doc_id: r for r in language_id.predict(own, model, ["doc_id", "lang"]).collect()}
    assert np.mean([got[i].lang == got[i].lang_pred for i in range(300, 400)]) > 0.95
    und = {r.doc_id for r in language_id.predict(docs, model, ["doc_id"]).collect() if r.lang_pred == "und"}
    blank = [r.lang_pred == 'und' for r in language_id.predict(docs.filter('doc_id is null'), model, ['doc_id']).collect()]
    assert und - {None} == {1, 2, 3} and sorted(blank) == [False, True]
    assert language_id.fit(none) is None and language_id.predict(docs, None, ["doc_id"]).filter("lang_pred != 'und'").count() == 0


def test_attention_network_gradients():
    model, x = toxicity.Model(), toxicity.Inputs(pa.array(["a bad day", "good words here and there"]))
    y, emb = np.array([1, 0]), model.embed(x)
    g = model.back(x, emb, x.index, x.mask, y)
    loss = lambda: float(np.mean(np.logaddexp(0, z := model.run(model.embed(x), x.index, x.mask).astype(np.float64)) - y * z))
    for name in ("xf", "hb", "aw", "av", "ow"):
        p, at = model.params[name], tuple(0 for _ in model.params[name].shape)
        keep, e = p[at], 2e-2
        p[at] = keep + e
        up = loss()
        p[at] = keep - e
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3, name
