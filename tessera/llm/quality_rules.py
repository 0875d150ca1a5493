"""Document quality rules in DataFrame functions only: counts, and divergence from language references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Character classes of the histogram, as Java patterns; white space is one more, and what is left counts as letters.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "stop": r"[.,;:?'\"()-]", "mark": r"[#*$%&|<>!@~^_=+\\/{}\[\]`]"}
#: Common words of the histogram (fixed values): frequent function words of the languages of the corpus, met in any case.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "on", "are", "as", "be", "this",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "nicht", "ein", "auf",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "dans", "pour", "pas", "par",
    "el", "los", "las", "del", "se", "por", "con", "una", "su", "no", "para", "es", "lo",
)


def document_counts(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """One row for each row of docs (carry, lang, text): the column carry, counts, character histogram and common-word histogram.

    A narrow projection without a shuffle.  An eight-word window is the hash of
    eight word hashes; only a document in which two windows agree sorts its windows
    with their positions and adds up the words that the repeated ones cover, so all
    work is O(n log n) in a document's length.  Null texts count as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(carry), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    # nearly all white space is blanks and line ends, which need no pattern
    other = F.col("text").rlike(r"[\t\x0b\x0c\r]")
    parts = F.when(other, F.split("text", SPACE)).otherwise(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
    black = F.length(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    space = F.when(other, F.regexp_count("text", F.lit(SPACE))).otherwise(F.length("text") - black).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("parts", parts).select(
        carry, "lang", F.length("text").cast("long").alias("n_chars"),
        F.array_remove(F.transform("parts", lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))).alias("h"), space.alias("space"),
        F.filter(F.transform("parts", lambda w: F.xxhash64(F.lower(w))), lambda x: x.isin(*[F.xxhash64(F.lit(c)) for c in COMMON])).alias("common"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in CLASSES.items()],
    )
    h, n = F.col("h"), F.size("h")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("w", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("distinct_w", F.size(F.array_distinct("w")))
    # sorted (window, position); stays empty unless two windows agree
    pairs = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.col("distinct_w") < F.size("w"), pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    s = F.col("s")
    again = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(again, lambda e: e["i"])))
    # each repeated window adds its words beyond the one before
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )
    words = [(F.size("common") - F.size(F.array_remove("common", F.xxhash64(F.lit(w))))).cast("long") for w in COMMON]
    counted = [F.col(c) for c in ("space", *CLASSES)]
    return rows.select(
        carry, "lang", "n_chars", n.cast("long").alias("n_words"), (F.col("n_chars") - F.col("space")).alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.array(F.col("n_chars") - sum(counted[1:], counted[0]), *counted).alias("chars"), F.array((n - F.size("common")).cast("long"), *words).alias("common"),
    )


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (base 2), the square of the distance, between two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) / 2 + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0) / 2

    return F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda x, y: x + y), F.lit(0.0))


def _shares(counts: str) -> Column:
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.transform(counts, lambda c: F.when(whole > 0, c / whole).otherwise(0.0))


def _by_chance(q: Column, n: Column, spread: float) -> Column:
    """The divergence from q that n words drawn from q have by chance: its mean and `spread` standard deviations.

    8 ln 2 n times the divergence is nearly chi-square; a bin adds one degree of
    freedom, or less where it is so rare that it is mostly empty (half its share).
    """
    unit = F.lit(8 * math.log(2)) * F.greatest(n, F.lit(1))
    mean = F.aggregate(q, F.lit(0.0), lambda x, share: x + F.least(share / 2, 1 / unit))
    return mean + spread * F.sqrt(2 * mean / unit)


def judge(counts: DataFrame, max_char_distance: float, max_word_distance: float, spread: float, min_words: int, min_reference: int, base_words: int, base_repeat: int) -> DataFrame:
    """counts (a written table of document_counts) with base_failed, char_distance, word_distance, word_limit and kept."""
    base = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_repeat * F.col("n_words"))
    counts = counts.withColumn("base_failed", base)
    sizes = {"chars": len(CLASSES) + 2, "common": len(COMMON) + 1}
    sums = [F.sum(F.col(name)[i]).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    reference = counts.where(~F.col("base_failed")).groupBy("lang").agg(F.count("*").alias("r_n"), *sums)
    reference = reference.select(F.col("lang").alias("r_lang"), "r_n", *[F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"r_{name}") for name, n in sizes.items()])
    reference = materialize(reference.select("r_lang", "r_n", *[_shares(f"r_{name}").alias(f"r_{name}") for name in sizes]), "languages")
    if reference.count() <= 10_000:  # one row of shares for each language code, under 1 kB each
        reference = F.broadcast(reference)
    both = counts.join(reference, F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    both = both.withColumn("char_distance", F.sqrt(_divergence(_shares("chars"), F.col("r_chars")))).withColumn("word_distance", F.sqrt(_divergence(_shares("common"), F.col("r_common"))))
    both = both.withColumn("word_limit", F.sqrt(max_word_distance**2 + _by_chance(F.col("r_common"), F.col("n_words"), spread)))
    guarded = (F.col("n_words") >= min_words) & (F.col("r_n") >= min_reference)
    odd = F.coalesce(guarded & ((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > F.col("word_limit"))), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_rules(
    docs: DataFrame, max_char_distance: float = 0.3, max_word_distance: float = 0.2, spread: float = 3.0, min_words: int = 50, min_reference: int = 20, base_words: int = 20, base_repeat: int = 30
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, word_limit, kept.

    base_failed: fewer than base_words words, or more than base_repeat percent of
    the words in repeated eight-word windows.  The method compares two histograms
    of each document with the reference of its language (the sums over all
    documents of that lang which pass the base; null is a language): character classes, and common
    words with all other words as one more bin.  kept is false if base_failed, or
    if a Jensen-Shannon distance exceeds its limit and the guards hold: min_words
    words in the document, min_reference documents in the reference.

    A short text is far from its language by chance.  So the limit of the word
    distance grows as the text gets shorter: max_word_distance squared, plus the
    divergence that a sample of so many words from the reference has on average and
    `spread` standard deviations of it.

    One narrow pass over the texts writes the counts; references are one partial
    aggregation by language.  Null or empty texts have zero counts and fail the
    base; an empty table gives an empty result; repeated rows are judged alike.
    """
    counts = materialize(document_counts(docs), "quality")
    judged = judge(counts, max_char_distance, max_word_distance, spread, min_words, min_reference, base_words, base_repeat)
    rounded = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance", "word_limit")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *rounded, "kept")


def keep_quality(
    docs: DataFrame, max_char_distance: float = 0.3, max_word_distance: float = 0.2, spread: float = 3.0, min_words: int = 50, min_reference: int = 20, base_words: int = 20, base_repeat: int = 30
) -> DataFrame:
    """The rows of docs (doc_id, lang, text, ...) that quality_rules keeps, all columns as they are.

    Rows travel with their counts through one written table, so no text is shuffled
    and no row needs a key.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.lang").alias("lang"), F.col("row.text").alias("text"))
    counts = materialize(document_counts(rows, "row"), "quality")
    return judge(counts, max_char_distance, max_word_distance, spread, min_words, min_reference, base_words, base_repeat).where("kept").select("row.*")
