"""Quality rules in a bitmask ledger.

Measurements of a text are taken once and every rule is evaluated once on them; the failures of a
row are the bits of one number. A policy is a set of rules, hence a mask: applying a new version,
or asking what a rule does on its own, reads the stored ledger and no text.

Everything is a DataFrame operation on built-in functions and each row is judged alone, so there
is no shuffle. The repeated windows of a text are first looked for by hash; only texts that have
some compare them in full, sorted, so a long repetitive text costs n log n.

Defined results: a NULL or empty text, or one of white space, has no words and fails only the
rule ``few_words``. Rows are judged as they come, repeated or not; other columns are kept by
``ledger``, where a column with the name of a measurement is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecast.llm.common import NOT_SPACE, text_of, words_of

WINDOW_WORDS = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper", "n_letters",
    "n_stutters",
)

#: Rules in the order of their bits; a rule is true where a text fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "no_letters": "10 * n_letter_words < 6 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "stutter": "10 * n_stutters > 3 * n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << bit for bit, rule in enumerate(RULES) if rule in POLICIES[policy])


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words: words that lie in a window of eight that the text has twice or more."""
    w, size = WINDOW_WORDS, F.size("_words")
    starts = F.sequence(F.lit(0), size - w)
    window = lambda array, i: [F.get(array, i + k) for k in range(w)]  # noqa: E731  slice() would copy the whole array each time
    hashes = F.transform(starts, lambda i: F.xxhash64(*window("_hashes", i)))
    docs = docs.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    docs = docs.withColumn("_windows", F.when(size > w, hashes))
    docs = docs.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    texts = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window("_words", i)).alias("t"), i.alias("i")))
    docs = docs.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(texts)))
    same = lambda j, k: F.get("_sorted", j)["t"] == F.get("_sorted", k)["t"]
    repeated = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    docs = docs.withColumn("_at", F.when(F.col("_twice"), repeated))
    docs = docs.withColumn("_at", F.array_sort(F.transform("_at", lambda j: F.get("_sorted", j)["i"])))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda done, i: F.struct((done["n"] + i + w - F.greatest(i, done["upto"])).alias("n"), (i + w).alias("upto")),
        lambda done: done["n"],
    )
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements of its texts."""
    # The row's own columns travel as one, so no name of theirs meets a name used here.
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    text = F.col("_text")
    docs = docs.select(F.struct(*kept).alias("_row"), text_of(f"`{text_col}`").alias("_text")).withColumn("_words", words_of(text))
    docs = docs.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE)))
    measured = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(rf"{NOT_SPACE}*\p{{L}}{NOT_SPACE}*")).cast("long").alias("n_letter_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.size(F.filter(F.sequence(F.lit(0), F.size("_words")), lambda i: F.get("_words", i) == F.get("_words", i + 1)))
        .cast("long").alias("n_stutters"),
    )
    # Rows come out of a generator of one row: a filter on a measurement stays above it, where it would
    # otherwise be moved down and repeat the measuring inside itself.
    return _repeat_words(docs).select("_row", F.inline(F.array(measured))).select("_row.*", *MEASURES)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failed``, one bit per rule."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text_col).withColumn("failed", failed.cast("long"))


def fails(policy: str) -> Column:
    """Whether a row of a ledger fails the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    One pass over the ledger with a bitwise aggregate per rule; one row per rule comes out.
    """
    wanted = mask(policy)
    hits = F.col("failed").bitwiseAND(F.lit(wanted))
    names = [(rule, 1 << bit) for bit, rule in enumerate(RULES) if wanted >> bit & 1]
    counts = rows.agg(*[
        F.struct(
            F.lit(rule).alias("rule"), F.count_if(hits.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            F.count_if(hits == bit).alias("n_only_this"), F.count_if(hits != 0).alias("n_rejected"), F.bit_or(hits).alias("seen"),
        ).alias(rule)
        for rule, bit in names
    ])
    return counts.select(F.inline(F.array(*[F.col(rule) for rule, _ in names])))
