"""Quality rules as a ledger of failure bits, built with DataFrame functions only.

``ledger`` measures every document once and evaluates every rule once; bit *k* of ``failed``
is set where rule *k* fails. A policy is a version and the set of rules it enforces, so
``apply_policy`` and ``ablations`` only look at bits and never at texts again.

Words are runs of anything but space and the characters 9 to 13; a null text has none. Lines
are split at line feeds and count when they hold a word. A text is measured inside its row, so
a text takes memory in proportion to its own length. An empty table gives an empty ledger;
rows that share a ``doc_id`` stay separate; other columns of ``docs`` are not carried.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules by bit: true where the document fails. All are exact on integers.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
    "symbols": lambda: F.col("n_symbols") * 100 > F.col("n_words") * 10,
    "repeated_lines": lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 50,
    "short_words": lambda: F.col("word_chars") < F.col("n_words") * 2,
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 15,
    "capitals": lambda: F.col("n_capitals") * 2 > F.col("word_chars"),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}

#: Rules that a policy enforces, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": tuple(RULES),
}


def policy_mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["hash"] == b["hash"]) & (a["window"] == b["window"]), F.lit(False))


def _covered(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep those like a neighbour, join their spans."""
    windows = F.transform(
        hashes, lambda h, i: F.struct(h.alias("hash"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("window"), i.alias("at"))
    )
    repeated = _let(
        F.array_sort(windows), lambda s: F.filter(s, lambda w, i: _same(F.get(s, i - 1), w) | _same(F.get(s, i + 1), w))
    )
    starts = F.array_sort(F.transform(repeated, lambda w: w["at"]))
    spans = _let(starts, lambda s: F.transform(s, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - at, F.lit(WINDOW)))))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the text.

    Equal windows have equal hashes, so a text whose window hashes are all distinct has none,
    and only the others are sorted. Windows with equal hashes are compared word by word.
    """
    count = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    found = _let(
        _let(F.transform(words, lambda w: F.xxhash64(w)), windows),
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_covered(words, hashes)),
    )
    return F.when(count > WINDOW, found).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)."""
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select(
        "doc_id",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    return table.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_capitals",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of every document and ``failed``, the bits of the rules it fails."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(rule(), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Add ``kept``: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that would be kept without it.

    The ledger is first counted by bit pattern, of which there are at most two to the number of rules.
    """
    mask = policy_mask(policy)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("documents"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in POLICIES[policy]])
    each = patterns.select("failed", "documents", F.inline(rules))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("documents")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("documents")).otherwise(0)).alias("kept_without"),
    )
