"""One query for each operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load


def part(n: int):
    """crc32 of the id as text, modulo n; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def held_out(n: int, which: int):
    """Rows that nothing is learned from; those without an id are among them."""
    return part(n).isin(which, -1)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(4, 2)))
    held = docs.withColumn("held_out", held_out(4, 2))
    return score(held, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import fit, score

    docs = load(spark, sf_dir, "documents").select("doc_id", "text", held_out(10, 0).alias("held_out"))
    model = fit(docs.filter("not held_out"), order=3)
    return score(docs, model, ["doc_id", "held_out"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(load(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests, encode_decode

    return digests(encode_decode(load(spark, sf_dir, "documents"), tokenizer_path()))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(load(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import Threshold, jaccard_components

    return jaccard_components(load(spark, sf_dir, "documents"), shingle=3, limit=Threshold(90, 100))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(3, 1))
    model = fit(docs.filter("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate, items_digest

    out = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), size=13)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(5, 0)))
    held = docs.withColumn("held_out", held_out(5, 0))
    return score(held, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(load(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_exact_dedup, op4_sentencepiece, op5_substring_dedup, op6_jaccard_join, op7_language_id, op8_decontamination, op9_quality, op10_line_dedup)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

#: DuckDB SQL for those that SQL can say. Edit distances there are of bytes, so other characters first become single bytes that texts don't have.
ORACLES = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
        FROM t
    """,
    "op5_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (k) WHERE low < doc_id),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        both_g AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_g JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b FROM reach r JOIN link ON a = other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
        item AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM.format("text")} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM item WHERE len(w) > 0)),
        size AS (SELECT DISTINCT n FROM win),
        own AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size)),
        hit AS (SELECT DISTINCT doc_id, own.n, i, item FROM own JOIN win USING (k)),
        word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op10_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        line AS (SELECT doc_id, x, p, length(x) >= 24 AS long, length(x) >= 24 OR trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AS compared FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM d)),
        odd AS (SELECT string_agg(c, '') AS c, string_agg(chr(CAST(CASE WHEN r < 9 THEN r WHEN r < 27 THEN r + 5 ELSE 127 END AS INTEGER)), '') AS b FROM (SELECT c, row_number() OVER (ORDER BY c) AS r FROM (SELECT DISTINCT unnest(regexp_extract_all(x, '[^\\x00-\\x7F]')) AS c FROM line))),
        low AS (SELECT x, any_value(long) AS long, min((doc_id, p)) AS low FROM line WHERE compared GROUP BY x),
        byte AS (SELECT x, low, length(x) AS n, translate(x, coalesce(c, ''), coalesce(b, '')) AS y FROM low, odd WHERE long),
        near AS (SELECT a.x, min(b.low) AS low FROM byte a JOIN byte b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.x <> b.x WHERE levenshtein(a.y, b.y) <= 2 GROUP BY a.x),
        gone AS (SELECT doc_id, p FROM line JOIN low USING (x) LEFT JOIN near USING (x) WHERE least(low.low, near.low) < (doc_id, p)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY p) AS s FROM line ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(l), 0) - coalesce(n, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(s, '')) END AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
}
