"""Quality rules by distribution divergence, in column expressions only (operator 6).

Each text gets a histogram of character classes and one of common words. Both are compared with the histograms of whole
languages by Jensen-Shannon distance; a text far from every language is refused. Short texts say too little
about a distribution and are guarded by minimum lengths.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import others

# Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it was on are with as be this by from at",
    "es": "de la que el en y a los del se las por un para con no una su al es",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

#: Classes of characters, in the order in which they are taken out of a text; the rest is the last class.
CLASSES = {"lower": "\\p{Ll}", "upper": "\\p{Lu}", "space": "\\s", "point": "[.,;:?'\"()-]", "digit": "\\p{Nd}", "letter": "\\p{L}\\p{M}"}

LEAST_WORDS = 20
#: Percent of words in repeated windows beyond which a text fails the base rule.
MOST_REPEATED = 30
WINDOW = 8
#: Characters and words that a text must have to be judged by its characters or by its common words.
LEAST_CHARACTERS, LEAST_COMPARED = 300, 150
#: Jensen-Shannon distances (0 to 1) beyond which a text is refused.
MOST_CHARACTER_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.30
_SPACE = " \t\n\u000b\f\r"
_SYMBOLS = "#*$%&|<>"


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of the hashes of their words. Only texts with an equal pair are looked
    at further: their windows are sorted by hash, and neighbours tell which places are covered.
    """
    n = F.size("_words")
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    order = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_order", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order))

    def twin(e: Column, k: Column) -> Column:
        same = (F.get(F.col("_order"), k - 1)["h"] == e["h"]) | (F.get(F.col("_order"), k + 1)["h"] == e["h"])
        return F.when(same, e["i"])

    df = df.withColumn("_places", F.array_sort(F.filter(F.transform("_order", twin), lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_places", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds ``_characters`` and ``_common``: counts of character classes and of common words."""
    left, counts = "_text", []
    for k, pattern in enumerate(CLASSES.values()):
        stripped = f"_left{k}"
        df = df.withColumn(stripped, F.regexp_replace(left, f"[{pattern}]+" if not pattern.startswith("[") else f"{pattern}+", ""))
        counts.append(F.length(left) - F.length(stripped))
        left = stripped
    df = df.withColumn("_characters", F.array(*counts, F.length(left)).cast("array<double>"))
    spoken = F.split(F.lower("_text"), "[^\\p{L}\\p{M}]+")
    df = df.withColumn("_spoken", F.concat(F.lit(" "), F.array_join(F.filter(spoken, lambda w: w.isin(VOCABULARY)), "  "), F.lit(" ")))
    common = [((F.length("_spoken") - F.length(F.replace(F.col("_spoken"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in VOCABULARY]
    rest = F.greatest(F.col("n_words") - sum(common[1:], common[0]), F.lit(0.0))
    return df.withColumn("_common", F.array(*common, rest).cast("array<double>"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_HELD = ["_characters", "_common"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of the base rule and the two histograms (``_characters``, ``_common``)."""
    own = others(docs, [*MEASURES, "kept", "character_distance", "word_distance"])
    df = docs.withColumn("_text", F.coalesce(column(text).cast("string"), F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_text", "[ \\t-\\r]+"), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", (F.length("_text") - _count(F.col("_text"), _SPACE)).cast("long"))
    df = df.withColumn("n_symbols", _count(F.col("_text"), _SYMBOLS))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = _histograms(_repeated(df))
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return df.select(*own, *MEASURES, *_HELD)


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes and of the common words in the texts of a language."""

    language: str
    characters: tuple[float, ...]
    common: tuple[float, ...]


def language_references(measured: DataFrame, lang: str = "lang") -> list[Reference]:
    """The histograms of each language of ``COMMON_WORDS``, summed over all its documents that pass the base rule.

    One aggregate whose result has a row for each of the four languages. Languages without such documents have none.
    """
    sizes = {"_characters": len(CLASSES) + 1, "_common": len(VOCABULARY) + 1}
    sums = [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    rows = measured.where(column(lang).isin(*COMMON_WORDS) & ~F.col("base_failed")).groupBy(column(lang).alias("language")).agg(*sums).collect()
    out = []
    for r in sorted(rows, key=lambda r: r["language"]):
        shares = {c: [r[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()}
        if all(sum(v) > 0 for v in shares.values()):
            out.append(Reference(r["language"], *(tuple(x / sum(v) for x in v) for v in shares.values())))
    return out


def js_distance(shares: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance, with logarithms to base 2, of an array of shares from fixed ones.

    sqrt(H(m) - (H(p) + H(q)) / 2) with m = (p + q) / 2; between 0 (equal) and 1 (nothing in common).
    """

    def entropy_term(x: Column) -> Column:
        return F.when(x > 0, -x * F.log2(x)).otherwise(0.0)

    fixed = F.array(*[F.lit(float(x)) for x in reference])
    terms = F.zip_with(shares, fixed, lambda p, q: entropy_term((p + q) / 2) - entropy_term(p) / 2)
    own = sum(-x * log2(x) for x in reference if x > 0) / 2
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) - own, F.lit(0.0)))


def judge(measured: DataFrame, references: list[Reference]) -> DataFrame:
    """``measured`` without the histograms, with ``character_distance``, ``word_distance`` and ``kept``.

    The distances are those from the nearest language; null where a text is too short for the comparison or there is no
    reference. ``kept``: the base rule is passed and no distance is beyond its bound.
    """
    own = [column(c) for c in measured.columns if c not in _HELD]
    total = {c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) for c in _HELD}
    df = measured.withColumn("_n_characters", total["_characters"]).withColumn("_n_common", total["_common"])
    df = df.withColumn("_characters", F.transform("_characters", lambda x: x / F.greatest(F.col("_n_characters"), F.lit(1.0))))
    df = df.withColumn("_common", F.transform("_common", lambda x: x / F.greatest(F.col("_n_common"), F.lit(1.0))))

    def nearest(shares: str, of: str, enough: Column) -> Column:
        distances = [js_distance(F.col(shares), getattr(r, of)) for r in references]
        return F.when(enough, F.array_min(F.array(*distances))) if distances else F.lit(None).cast("double")

    df = df.withColumn("character_distance", nearest("_characters", "characters", F.col("_n_characters") >= LEAST_CHARACTERS))
    df = df.withColumn("word_distance", nearest("_common", "common", F.col("n_words") >= LEAST_COMPARED))
    near = (F.coalesce("character_distance", F.lit(0.0)) <= MOST_CHARACTER_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return df.select(*own, "character_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))
