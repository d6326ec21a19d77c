"""Quality rules with thresholds learned from mergeable quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm.common import cut, words_of

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Fence:
    """Rejects values beyond ``median + max(gap, reach * (median - lower quartile))``.

    Only the half of the distribution on the clean side sets the reach, so up to half of a source
    may be junk before the threshold moves.
    """

    metric: str
    gap: float


# Distances from a source's own median, not levels: what is usual in a source passes at any level.
FENCES = (
    Fence("symbol_share", 0.1),
    Fence("mark_share", 0.5),
    Fence("upper_share", 0.25),
    Fence("dup_line_share", 0.45),
    Fence("repeat_share", 0.2),
    Fence("word_length", 3.0),
)
REACH = 6.0
#: A (language, source) with fewer judged rows takes the merged sketches of its language, and a language of all rows.
MIN_GROUP = 100
#: Sketch accuracy; groups of up to this many rows have exact quantiles.
SKETCH_K = 4096


def _dropped(text: Column, characters: str) -> Column:
    """How many code points of the text are among the characters."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts per row: words, word characters, symbols, repeated lines and words in repeated 8-word windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("__id"),
        F.col(lang_col).alias("__lang"),
        F.col(source_col).alias("__source"),
        text.alias("__text"),
        words_of(text).alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    hashed = split.select(
        "__id",
        "__lang",
        "__source",
        F.size("__words").cast("long").alias("n_words"),
        (F.char_length("__text") - _dropped(F.col("__text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        _dropped(F.col("__text"), SYMBOLS).alias("n_symbols"),
        _dropped(F.col("__text"), "!?").alias("n_marks"),
        _dropped(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    windows = hashed.withColumn(
        "__windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW))),
        ),
    ).drop("__hashes")
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    ranked = windows.withColumn(
        "__ranked", F.when(repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("__windows")
    starts = ranked.withColumn(
        "__starts",
        F.expr(
            "array_sort(transform(filter(__ranked, (x, i) -> x.h <=> get(__ranked, i - 1).h OR x.h <=> get(__ranked, i + 1).h), x -> x.i))"
        ),
    ).drop("__ranked")
    covered = F.expr(
        f"coalesce(aggregate(transform(__starts, (p, i) -> least({WINDOW}, coalesce(get(__starts, i + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)"
    )
    return starts.withColumn("n_repeat_words", covered).drop("__starts")


def thresholds(judged: DataFrame) -> DataFrame:
    """Quantile sketches per (language, source), merged per language and over all, turned into upper limits.

    ``judged`` has ``__lang``, ``__source`` and the metrics. One row per (language, source).
    """
    names = [fence.metric for fence in FENCES]
    local = judged.groupBy("__lang", "__source").agg(
        F.count(F.lit(1)).alias("n_1"), *[F.kll_sketch_agg_double(name, SKETCH_K).alias(f"{name}_1") for name in names]
    )
    by_lang = local.groupBy("__lang").agg(F.sum("n_1").alias("n_2"), *[F.kll_merge_agg_double(f"{name}_1", SKETCH_K).alias(f"{name}_2") for name in names])
    overall = by_lang.agg(F.struct(*[F.kll_merge_agg_double(f"{name}_2", SKETCH_K).alias(name) for name in names]).alias("all")).scalar()
    joined = local.withColumnRenamed("__lang", "__l").join(by_lang, F.col("__l").eqNullSafe(F.col("__lang"))).drop("__lang").withColumn("__all", overall)
    level = F.when(F.col("n_1") >= MIN_GROUP, 1).when(F.col("n_2") >= MIN_GROUP, 2).otherwise(3)
    picked = joined.withColumn("level", level).select(
        F.col("__l").alias("t_lang"),
        F.col("__source").alias("t_source"),
        *[
            F.when(F.col("level") == 1, F.col(f"{name}_1")).when(F.col("level") == 2, F.col(f"{name}_2")).otherwise(F.col("__all")[name]).alias(name)
            for name in names
        ],
    )
    limits = []
    for fence in FENCES:
        low, mid = (F.kll_sketch_get_quantile_double(fence.metric, F.lit(q)) for q in (0.25, 0.5))
        limits.append((mid + F.greatest(F.lit(fence.gap), REACH * (mid - low))).alias(f"max_{fence.metric}"))
    return picked.select("t_lang", "t_source", *limits)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base verdict and learned verdict of every row, with the limits of its language and source.

    ``base_failed``: fewer than 20 words, or over 30 % of the words lie in repeated 8-word windows.
    Rows that pass it feed the sketches; a row is kept if it passes it and none of its metrics
    exceeds the limit of its (language, source).

    Null texts count as empty and fail. A null language or source is a value of its own. Repeated
    rows are each judged. An empty table gives no rows. Only the four named columns are read, so
    other columns may have any name.
    """
    n = F.col("n_words")
    measured = measure(docs, id_col, text_col, lang_col, source_col).select(
        "*",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        *[
            F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0)).alias(name)
            for name, top, bottom in (
                ("symbol_share", F.col("n_symbols"), n),
                ("mark_share", F.col("n_marks"), n),
                ("upper_share", F.col("n_upper"), F.col("word_chars")),
                ("dup_line_share", F.col("n_dup_lines"), F.col("n_lines")),
                ("repeat_share", F.col("n_repeat_words"), n),
                ("word_length", F.col("word_chars"), n),
            )
        ],
    )
    # Narrow rows without texts, used by the sketches and by the join below.
    measured = cut(measured)
    limits = thresholds(measured.where("NOT base_failed"))
    over = F.lit(False)
    for fence in FENCES:
        over = over | F.coalesce(F.col(fence.metric) > F.col(f"max_{fence.metric}"), F.lit(False))
    joined = measured.join(limits, F.col("__lang").eqNullSafe(F.col("t_lang")) & F.col("__source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~over).alias("kept"),
        *[f.metric for f in FENCES],
        *[f"max_{f.metric}" for f in FENCES],
    )
