"""Quality rules: shares of repetition, and divergence from language references.

A document is compared with the reference of its language, which is the sum over all
documents of that language: a histogram of character classes and one of common words.
The distance is the square root of the Jensen-Shannon divergence in bits (0 to 1). Each
histogram is judged only from a least length on, below which it says little. A document
without a language is compared with the sum over all documents.

Everything is made of Spark's own expressions; only the references, one row per language,
are shuffled. Null is read as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.texts import read, text_column
from crashgrid.sources.storage import materialise

# White space, signs that count as symbols, limits of the base rules.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

#: Frequent function words per language code, in the order of the histogram. Languages
#: that are not listed are judged by character classes alone.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as by".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
}
#: Least lengths and largest distances.
LEAST_CHARS, LEAST_COMMON_BASE = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.3

#: Character classes as complements for removal; what is left over is the last class.
_REMOVED = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "symbol": "[^#*$%&|<>]+",
    "punctuation": "[^.,;:!?'\"()\\[\\]{}/+=_~^`@\\\\-]+",
    "wide": "[\\x00-\\x7F]+",
}
_CLASSES = (*_REMOVED, "blank", "rest")


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_w`` (words) and the base counts; windows are compared by 64-bit hashes."""
    trimmed = F.btrim(F.col(text), F.lit(BLANKS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))
    split = docs.withColumn("_w", words).withColumn("_size", F.size("_w"))
    hashes = F.expr(
        f"transform(if(_size >= {WINDOW}, sequence(0, _size - {WINDOW}), cast(array() as array<int>)),"
        f" i -> xxhash64({', '.join(f'_w[i + {j}]' for j in range(WINDOW))}))"
    )
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    found = split.withColumn("_h", hashes).withColumn("_l", lines).withColumn("_sorted", F.expr(_SORTED))
    return found.select(
        *docs.columns,
        "_w",
        F.col("_size").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, _REMOVED["symbol"], "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
    )


#: Hashes with their places, sorted, if any occurs twice; else nothing.
_SORTED = """if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h:bigint,i:int>>),
  sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))"""

#: Words covered by windows whose hash occurs twice or more: neighbours in ``_sorted``.
_REPEATED = f"""
aggregate(
  sort_array(transform(
    filter(_sorted, (p, j) -> coalesce(get(_sorted, j - 1).h = p.h, false) or coalesce(get(_sorted, j + 1).h = p.h, false)),
    p -> p.i)),
  named_struct('n', 0L, 'last', -{WINDOW}),
  (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"""


def histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Adds ``_classes`` and ``_common``, counts as arrays of doubles.

    ``_common`` follows COMMON_WORDS of the language, then all other words; it is null for
    languages that are not listed.
    """
    sizes = {name: F.length(F.regexp_replace(text, pattern, "")).cast("double") for name, pattern in _REMOVED.items()}
    blank = (F.length(text) - F.col("word_chars")).cast("double")
    counted = docs.withColumn("_counts", F.array(*sizes.values(), blank))
    rest = F.length(text) - F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x)
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    frequent = F.filter("_w", lambda w: F.lower(w).isin(every))
    joined = F.concat(F.lit(" "), F.lower(F.array_join(frequent, "  ")), F.lit(" "))
    counted = counted.withColumn("_classes", F.concat("_counts", F.array(rest))).withColumn("_joined", joined)
    common = F.lit(None).cast("array<double>")
    for code, words in COMMON_WORDS.items():
        vocabulary = F.array(*[F.lit(f" {w} ") for w in words])
        each = F.transform(
            vocabulary,
            lambda w: (F.length("_joined") - F.length(F.replace("_joined", w, F.lit("")))) / F.length(w),
        )
        common = F.when(F.col(lang) == code, each).otherwise(common)
    counted = counted.withColumn("_own", common)
    others = F.col("n_words") - F.aggregate("_own", F.lit(0.0), lambda a, x: a + x)
    return counted.withColumn("_common", F.concat("_own", F.array(others))).drop("_counts", "_joined", "_own", "_w")


def _sums(column: str, size: int) -> list[Column]:
    return [F.sum(F.get(column, F.lit(i))) for i in range(size)]


def references(counted: DataFrame, lang: str) -> DataFrame:
    """Per language: sums of both histograms; the row with a null language sums all documents."""
    longest = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.array(*_sums("_classes", len(_CLASSES))).alias("_ref_classes")]
    sums += [F.array(*_sums("_common", longest)).alias("_ref_common")]
    return counted.rollup(F.col(lang).alias("_key")).agg(F.grouping_id().alias("_all"), *sums).where(
        (F.col("_all") == 1) | F.col("_key").isNotNull()
    ).drop("_all")


def _distance(one: str, other: str) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; null without counts."""
    shares = f"""zip_with(transform({one}, x -> x / nullif(aggregate({one}, 0D, (a, y) -> a + y), 0D)),
      transform({other}, x -> x / nullif(aggregate({other}, 0D, (a, y) -> a + y), 0D)), (p, q) -> struct(p, q))"""
    term = "if({0} > 0, {0} * log2(2 * {0} / (s.p + s.q)), 0D)"
    divergence = f"aggregate({shares}, 0D, (a, s) -> a + ({term.format('s.p')} + {term.format('s.q')}) / 2)"
    return F.expr(f"if(aggregate({one}, 0D, (a, y) -> a + y) > 0, sqrt(greatest({divergence}, 0D)), null)")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Base counts, both distances (``class_distance``, ``word_distance``) and the verdicts.

    ``columns`` of ``docs`` (all if not given) come along, except those that have one of
    the names added here. A distance that is not judged is null. A document is kept if no
    base rule and no judged distance speaks against it.
    """
    columns = docs.columns if columns is None else columns
    filled = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("_doc"),
        text_column(text).alias("_text"),
        F.col(lang).cast("string").alias("_lang"),
    )
    counted = histograms(base(filled, "_text"), "_text", "_lang").withColumn("_chars", F.length("_text")).drop("_text")
    # Read twice, for the references and for the verdicts.
    counted = materialise(counted, "quality")
    keyed = references(counted, "_lang")
    joined = counted.join(keyed, F.col("_lang").eqNullSafe(F.col("_key")), "left")
    long_enough = F.col("_chars") >= LEAST_CHARS
    many_words = F.col("n_words") >= LEAST_COMMON_BASE
    judged = joined.withColumn("class_distance", F.when(long_enough, _distance("_classes", "_ref_classes"))).withColumn(
        "word_distance", F.when(many_words & F.col("_common").isNotNull(), _distance("_common", "_ref_common"))
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    added = {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("n_dup_lines"),
        "n_repeat_words": F.col("n_repeat_words"),
        "base_failed": base_failed,
        "kept": ~base_failed & ~far,
        "class_distance": F.col("class_distance"),
        "word_distance": F.col("word_distance"),
    }
    own = [F.col(f"_doc.`{c}`") for c in columns if c not in added]
    return judged.select(*own, *[c.alias(n) for n, c in added.items()])


def op4_divergence_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir), columns=["doc_id"])
