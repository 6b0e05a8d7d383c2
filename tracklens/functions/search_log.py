"""A table of typed searches as columns: ranges, exact times, a wildcard and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.expr import DURATION, duration_ms, window_ms

#: The forms of time that a typed search may have.
BETWEEN = rf"(?i)between\s+({DURATION})\s+and\s+({DURATION})"
RANGE = rf"(?i)({DURATION})\s*(?:to|-)\s*({DURATION})"
OVER = rf">\s*({DURATION})"
UNDER = rf"<\s*({DURATION})"
EXACT = rf"\b({DURATION})\b"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _without(c: Column, pattern: str) -> Column:
    """The text without the pattern's first match."""
    case, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return _trim(F.regexp_replace(c, rf"(?s){case}^(.*?){bare}", "$1"))


def normalize_search_log(df: DataFrame, text_col: str = "query") -> DataFrame:
    """Adds ``min_ms, max_ms, exact_ms, window_ms, wildcard, keywords, is_empty``.

    Forms are looked for in this order, each once: ``between A and B``; else ``A to B`` or ``A-B``;
    else ``>A`` and ``<B``; else one exact time. Of what is left, the first word with a star is the
    wildcard, if it has other characters too; all other words are keywords.
    """
    null = F.lit(None).cast("long")
    q = F.col("_q")
    out = df.withColumn("_q", _trim(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("is_empty", q == "")
    out = out.withColumns({"_between": q.rlike(BETWEEN)})
    out = out.withColumns({"_range": ~F.col("_between") & q.rlike(RANGE)})
    plain = ~F.col("_between") & ~F.col("_range")
    out = out.withColumns({"_over": plain & q.rlike(OVER), "_under": plain & q.rlike(UNDER)})
    at = lambda p, k: F.regexp_extract(q, p, k)
    low = F.when(F.col("_between"), at(BETWEEN, 1)).when(F.col("_range"), at(RANGE, 1)).when(F.col("_over"), at(OVER, 1))
    high = F.when(F.col("_between"), at(BETWEEN, 2)).when(F.col("_range"), at(RANGE, 2))
    out = out.withColumns({"_low": low, "_high": high, "_limit": F.when(F.col("_under"), at(UNDER, 1))})
    rest = F.when(F.col("_between"), _without(q, BETWEEN)).when(F.col("_range"), _without(q, RANGE)).when(F.col("_over"), _without(q, OVER)).otherwise(q)
    out = out.withColumn("_q", rest)
    out = out.withColumn("_q", F.when(F.col("_under"), _without(q, UNDER)).otherwise(q))
    none = F.col("_low").isNull() & F.col("_high").isNull() & F.col("_limit").isNull()
    out = out.withColumn("_exact", F.when(none & q.rlike(EXACT), at(EXACT, 1)))
    out = out.withColumn("_q", F.when(F.col("_exact").isNotNull(), _without(q, EXACT)).otherwise(q))
    out = out.withColumn("_words", F.filter(F.split("_q", r"\s+"), lambda w: w != ""))
    starred = F.get(F.filter("_words", lambda w: w.contains("*")), F.lit(0))
    out = out.withColumn("wildcard", F.when(F.regexp_replace(starred, r"\*", "") != "", starred))
    place = F.when(F.col("wildcard").isNotNull(), F.array_position("_words", F.col("wildcard")) - 1).otherwise(F.lit(-1))
    kept = F.filter("_words", lambda w, i: i != place)
    made = {
        "min_ms": F.when(F.col("_low").isNotNull(), duration_ms(F.col("_low"))).otherwise(null),
        "max_ms": F.when(F.col("_limit").isNotNull(), duration_ms(F.col("_limit")) - 1).when(
            F.col("_high").isNotNull(), duration_ms(F.col("_high")) + window_ms(F.col("_high")) - 1
        ).otherwise(null),
        "exact_ms": F.when(F.col("_exact").isNotNull(), duration_ms(F.col("_exact"))).otherwise(null),
        "window_ms": F.when(F.col("_exact").isNotNull(), window_ms(F.col("_exact"))).otherwise(null),
        "wildcard": F.col("wildcard"),
        "keywords": F.nullif(F.array_join(kept, " "), F.lit("")),
        "is_empty": F.col("is_empty"),
    }
    # Inlined as one struct: predicates on the results stay above and do not copy these expressions.
    plain_columns = [F.col(c) for c in df.columns if c not in made]
    return out.select(*plain_columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
