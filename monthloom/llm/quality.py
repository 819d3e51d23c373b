"""Quality rules: base rules and divergence from language references.

Two histograms describe a document: its characters by class, and its words by the common
words of its language. References are the same histograms summed over all documents of a
language. The Jensen-Shannon distance (base 2, from 0 to 1) between document and reference
rejects text that does not look like its language, such as tables, symbol runs, shouting or
repeated words. Short documents have histograms too coarse to judge: below `MIN_CHARS` and
`MIN_WORDS` a distance is null and rejects nothing. Above that, the allowed distance shrinks
with the root of the length, as the distance that chance alone gives does.

A word is common in a language if at least `COMMON_SHARE` of the language's words are it,
so there are at most 1 / `COMMON_SHARE` of them whatever the input.

Everything is DataFrame functions. Repeated windows are found in the row: the hashes of all
windows are sorted only where a distinct count shows a repeat.

Defined cases: a null or empty text has no words and fails the base rules; a null language
has a reference of its own (all documents without one); repeated rows are judged once per
row; extra columns are ignored; windows and common words are compared by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.arrays import let
from monthloom.session import stage

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_TOTAL_WORDS = 20
REPEAT_PERCENT = 30
COMMON_SHARE = 0.004
#: Slots of the hash table of common words.
SLOTS = 256
MIN_CHARS = 200
MIN_WORDS = 50
#: Largest distances, and what chance adds to them: so much over the root of the length.
MAX_CLASS_DISTANCE, CLASS_CHANCE = 0.2, 1.0
MAX_WORD_DISTANCE, WORD_CHANCE = 0.2, 1.6

#: Character classes, taken off a text one after the other; what is left is the last class.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+",
    "blank": BLANKS,
    "mark": r"[\x00-\x7F]+",
}
NAMES = [*CLASSES, "other"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(tokens: Column) -> Column:
    """Words inside `WINDOW`-word windows that occur twice or more, the first included."""

    def windows(h: Column) -> Column:
        """Hashes of all windows, from those of their words."""
        return F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    hashes = let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)

    def covered(windows: Column) -> Column:
        """From (hash, place) in order: places whose hash a neighbour shares, then their union."""
        places = F.sort_array(
            F.filter(
                F.transform(
                    windows,
                    lambda w, k: F.when(
                        (F.get(windows, k - 1)["h"] == w["h"]) | (F.get(windows, k + 1)["h"] == w["h"]),
                        w["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        )
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            zero,
            lambda a, p: F.struct(
                (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
            ),
            lambda a: a["n"],
        )

    def count(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(let(in_order, covered))

    return let(hashes, count)


def _divergence(pairs: list[tuple[Column, Column]]) -> Column:
    """Jensen-Shannon divergence of histograms given as pairs of shares."""

    def side(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    return reduce(lambda a, b: a + b, (side(p, q) + side(q, p) for p, q in pairs)) / 2


def features(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Per row: id, language, words, character classes, base counts. Staged by the caller."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), t.alias("text"))
    rows = rows.withColumn("tokens", words_of(F.col("text"))).withColumn("rest0", F.col("text"))
    for k, pattern in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
    lengths = [F.length(f"rest{k}") for k in range(len(CLASSES) + 1)]
    counts = [a - b for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1]]
    return rows.select(
        "id",
        "lang",
        "tokens",
        F.size("tokens").cast("long").alias("n_words"),
        (F.length("text") - counts[NAMES.index("blank")]).cast("long").alias("word_chars"),
        counts[NAMES.index("symbol")].cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars_"),
        F.array(*counts).alias("classes"),
    )


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: a hash table of its common words, and their shares."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), t.alias("text"))
    counts = (
        rows.select("lang", F.explode(words_of(F.lower("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    counts = stage(counts)
    totals = stage(counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "lang_"))
    return (
        counts.join(totals, F.col("lang").eqNullSafe(F.col("lang_")))
        .where(F.col("n") >= COMMON_SHARE * F.col("total"))
        .groupBy("lang")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share")))
            ).alias("common")
        )
        .select("lang", _hash_table(F.col("common.word")).alias("common"), F.col("common.share").alias("shares"))
    )


def _slot(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(SLOTS)).cast("int")


def _hash_table(words: Column) -> Column:
    """Slots by hash; each has the hashes of its words and their places in the list, from 1."""
    entries = F.transform(words, lambda w, i: F.struct(F.xxhash64(w).alias("h"), (i + 1).alias("place")))

    def slots(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(SLOTS - 1)),
            lambda k: let(
                F.filter(found, lambda e: _slot(e["h"]) == k),
                lambda own: F.struct(own["h"].alias("h"), own["place"].alias("place")),
            ),
        )

    return let(entries, slots)


def _place(table: Column, hash_: Column) -> Column:
    """The place of a word in the list of common ones; 0 if it is none."""
    return let(
        F.get(table, _slot(hash_)),
        lambda own: F.coalesce(
            F.get(own["place"], (F.array_position(own["h"], hash_) - 1).cast("int")), F.lit(0)
        ).cast("bigint"),
    )


def word_divergence(tokens: Column, common: Column, shares: Column) -> Column:
    """Divergence over the common words and one bin for all others.

    Places of the words in the list of common ones (0: another word) are sorted; a bin's
    count is the distance between first places. Bins the document lacks add half their
    reference share."""
    places = F.transform(F.transform(tokens, lambda w: F.xxhash64(F.lower(w))), lambda h: _place(common, h))

    def of_sorted(s: Column) -> Column:
        return let(
            F.array_distinct(s), lambda d: let(F.transform(d, lambda k: F.array_position(s, k)), lambda at: total(s, d, at))
        )

    def total(s: Column, d: Column, at: Column) -> Column:
        size = F.size(s).cast("double")
        rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)

        def bin_(k: Column, i: Column) -> Column:
            p = (F.coalesce(F.get(at, i + 1), F.size(s) + F.lit(1).cast("bigint")) - F.get(at, i)) / size
            q = F.when(k == 0, rest).otherwise(F.get(shares, (k - 1).cast("int")))
            return F.struct(
                (p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)).alias("v"),
                q.alias("q"),
            )

        return F.aggregate(
            F.transform(d, bin_),
            F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("q")),
            lambda a, x: F.struct((a["v"] + x["v"]).alias("v"), (a["q"] + x["q"]).alias("q")),
            lambda a: F.greatest(F.lit(0.0), (a["v"] + 1 - a["q"]) / 2),
        )

    return let(F.sort_array(places), of_sorted)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document row: base counts, the two distances and the verdicts."""
    words = stage(references(docs, doc_id, text, lang))
    found = stage(
        features(docs, doc_id, text, lang)
        .join(words.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left")
        .withColumn(
            "word_distance",
            F.when(F.col("n_words") >= MIN_WORDS, F.sqrt(word_divergence(F.col("tokens"), F.col("common"), F.col("shares")))),
        )
        .drop("tokens", "common", "shares", "lang_")
    )
    sums = found.groupBy("lang").agg(
        *(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(NAMES))),
        F.sum("n_chars_").alias("all_"),
    )
    sums = stage(sums).withColumnRenamed("lang", "lang_")
    judged = found.join(sums, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    shares = [
        (F.get("classes", F.lit(k)) / F.col("n_chars_"), F.col(f"c{k}") / F.col("all_")) for k in range(len(NAMES))
    ]
    distance = F.sqrt(F.greatest(F.lit(0.0), _divergence(shares)))
    failed = (F.col("n_words") < MIN_TOTAL_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    allowed = lambda most, chance, n: most + chance / F.sqrt(n)
    far = F.coalesce(
        F.col("class_distance") > allowed(MAX_CLASS_DISTANCE, CLASS_CHANCE, "n_chars_"), F.lit(False)
    ) | F.coalesce(F.col("word_distance") > allowed(MAX_WORD_DISTANCE, WORD_CHANCE, "n_words"), F.lit(False))
    return judged.withColumn(
        "class_distance", F.when(F.col("n_chars_") >= MIN_CHARS, distance)
    ).select(
        F.col("id").alias(doc_id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )


def op1_divergence_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
