"""One registered query per operator, over the whole of its table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, cover_search, decontaminate, gam, language, suffix_dedup, superkmer, toxicity
from . import periodic_runs as runs
from .common import documents, held_out
from .huffman_ids import read_ids, write_ids
from .packing import pack_documents
from .rule_ledger import apply_policy, ledger, policy_mask
from .simhash_vp import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def labels(spark, sf, column):
    """(doc_id, label)"""
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(column).alias("label"))


@register
def op1_toxicity(spark, sf):
    docs, held = documents(spark, sf), held_out(1, 3)
    model = toxicity.fit(docs, labels(spark, sf, "toxic").filter(~held))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", predicted, "evidence", "telling_windows", "n_windows")


@register
def op2_suffix_dedup(spark, sf):
    return suffix_dedup.removal(documents(spark, sf)).drop("spans", "kept")


@register
def op3_decontaminate(spark, sf):
    """One row per contaminated document and benchmark item."""
    return decontaminate.contaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).drop("k")


@register
def op4_rule_ledger(spark, sf):
    """The base rules and the verdict of the full policy."""
    kept = apply_policy(ledger(documents(spark, sf)), "full-1")
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base-1"))) != 0
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_capitals", "failed"
    )


ORACLE["op4_rule_ledger"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, ws[i : i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 100 > n_words * 20 THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 100 > n_words * 10 THEN 4 ELSE 0 END + CASE WHEN n_dup_lines * 100 > n_lines * 50 THEN 8 ELSE 0 END
    + CASE WHEN word_chars < n_words * 2 THEN 16 ELSE 0 END + CASE WHEN word_chars > n_words * 15 THEN 32 ELSE 0 END
    + CASE WHEN n_capitals * 2 > word_chars THEN 64 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
       n_lines, n_capitals, failed
FROM f
"""


@register
def op7_huffman_ids(spark, sf):
    """Decoded from the written files."""
    return read_ids(spark, write_ids(documents(spark, sf)), with_ids=False)


@register
def op8_packing(spark, sf):
    return pack_documents(documents(spark, sf))


@register
def op5_superkmer_dedup(spark, sf):
    return superkmer.removal(documents(spark, sf)).drop("spans", "kept")


@register
def op6_simhash_vp(spark, sf):
    return near_duplicates(documents(spark, sf), shingle=3, max_bits=3)


@register
def op9_gam_quality(spark, sf):
    docs, held = documents(spark, sf), held_out(2, 4)
    model = gam.fit(docs, labels(spark, sf, "quality").filter(~held))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return gam.score(docs, model).select("doc_id", held.alias("held_out"), "score", predicted)


@register
def op10_language(spark, sf):
    docs, held = documents(spark, sf), held_out(2, 4)
    model = language.fit(docs.filter(~held))
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "family")


@register
def op11_periodic_runs(spark, sf):
    """Runs of every document, a tenth of which first repeat a stretch of themselves up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = documents(spark, sf).select(
        "doc_id", "text", (F.floor(h / 10) % 2**31).cast("int").alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("looped")
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.filter("looped").select("doc_id", "text", "g", words.alias("words")).withColumn("n", F.size("words"))
    a, p = F.expr("g % n"), F.expr("cast(1 + floor((n - g % n) / (3 + g % 8)) as int)")
    loop = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), 4 + g % 8)), 1, n - a)), ' ')")
    placed = split.withColumn("a", F.when(F.col("n") > 0, a).otherwise(0)).withColumn("p", F.when(F.col("n") > 0, p).otherwise(1))
    looped = placed.select("doc_id", F.when(F.col("n") > 0, loop).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(docs.filter("not looped").select("doc_id", "text").unionByName(looped))
    best = found.withColumn("best", runs.densest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@register
def op13_collocations(spark, sf):
    return collocations.collocations(documents(spark, sf))


ORACLE["op13_collocations"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM t),
g AS (
  SELECT lang, k AS words, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, 5)) AS k FROM p))),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
cut AS (
  SELECT lang, words, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS x,
         array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
s AS (
  SELECT cut.lang, cut.words, cut.phrase, a, k, fx.f AS l, fy.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(fx.f AS HUGEINT) + fy.f) AS score
  FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i : i + w - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, words - w + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS w FROM f WHERE words > 2))),
around AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@register
def op12_cover_search(spark, sf):
    """Vectors with a null or non-finite component take no part."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    vectors = table.filter(finite).select("vec_id", whole.alias("vector"))
    return cover_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE["op12_cover_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
