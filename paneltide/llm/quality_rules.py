"""Quality rules: a table of thresholds compiled into one Spark projection.

The rules are data (:data:`RULES`): each names a ratio of a document's statistics and the range in
which it must lie. :func:`apply_rules` turns statistics and table into native Spark expressions;
no user function, join or shuffle is involved, so the operator runs inside the scan's own tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Rule(NamedTuple):
    name: str
    value: str  #: SQL expression over the statistics of :func:`statistics`
    low: float | None = None
    high: float | None = None


#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of to and in that is with for it a on be this as are by or from at was not an "
    "de la el los en que y un una del las se por con para su al lo "
    "le les des et du dans qui pour est sur pas au par plus avec ce il "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als"
).split()

#: The production table. A document is kept if every rule holds.
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("mean_word_chars", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("capital_letters", "n_capitals / greatest(word_chars, 1)", None, 0.5),
)

_SPACE = r"[\x20\x09-\x0D]"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct column ``_s`` of counts over the whole text (null: empty); other columns stay.

    n_words, word_chars, n_symbols, n_stop_words, n_capitals, n_lines (with a word), n_dup_lines,
    n_repeat_words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPACE + "+"), lambda w: w != "")
    out = docs.select(F.struct("*").alias("_row"), t.alias("_t"), words.alias("_w"))
    out = out.withColumn("_n", F.size("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = out.withColumn("_l", lines)
    hashes = F.transform("_w", lambda w: F.xxhash64(w))
    out = out.withColumn("_h", F.when(F.col("_n") >= 6, hashes))
    grams = F.when(
        F.col("_n") >= 6,
        F.transform(F.sequence(F.lit(1), F.col("_n") - 4), lambda i: F.xxhash64(*[F.element_at("_h", i + j) for j in range(5)])),
    )
    out = out.withColumn("_g", grams)
    # Only texts with a repeated window are sorted; the column is used more than once below, so it is not inlined.
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    stats = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("_p"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.select("_row", stats.alias("_s"))


def _covered(pairs: str) -> Column:
    """Words covered by 5-word windows whose hash occurs at least twice; ``pairs`` is (hash, place) in order."""
    hash_at = lambda i: F.get(pairs, i)["h"]  # noqa: E731  null outside the array
    twice = F.filter(
        F.transform(pairs, lambda x, k: F.when((x["h"] == hash_at(k - 1)) | (x["h"] == hash_at(k + 1)), x["i"])),
        lambda i: i.isNotNull(),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(F.array_sort(twice), zero, step, lambda a: a["n"])


def verdict(rules=RULES, stats: str = "_s") -> Column:
    """True if every rule holds; a ratio without a value (0/0) breaks its rule."""
    checks = []
    for r in rules:
        value = F.expr(_qualified(r.value, stats))
        checks += [value >= F.lit(r.low)] if r.low is not None else []
        checks += [value <= F.lit(r.high)] if r.high is not None else []
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _qualified(sql: str, stats: str) -> str:
    import re

    names = "n_words word_chars n_symbols n_stop_words n_capitals n_lines n_dup_lines n_repeat_words".split()
    sql = re.sub(r"/\s*(n_words)\b", r"/ nullif(\1, 0)", sql)
    return re.sub(r"\b(" + "|".join(names) + r")\b", rf"{stats}.\1", sql)


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, its statistics in ``stats``, and ``kept``.

    Null text counts as empty: no words, so it fails the length rule. Repeated rows each get their
    verdict; an empty table gives an empty table; any other column, of any name, is left alone.
    """
    s = statistics(docs, text)
    return s.select(F.col("_row").alias("row"), F.col("_s").alias("stats"), verdict(rules).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: base counts, the base verdict, and the table's verdict on what passes it."""
    out = apply_rules(docs.select("doc_id", "text"))
    failed = (F.col("stats.n_words") < 10) | (100 * F.col("stats.n_repeat_words") > 20 * F.col("stats.n_words"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        *[F.col(f"stats.{c}").alias(c) for c in ("n_stop_words", "n_capitals", "n_lines")],
    )
