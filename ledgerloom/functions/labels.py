"""Text labels for periods, names, durations and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words kept upper case, connectors kept lower case unless leading, months.
ACRONYMS = ["PO", "DPO", "DSO", "DIO", "CCC", "OTIF", "GL", "AR"]
CONNECTORS = ["by", "of", "vs", "to", "a", "an", "the", "and", "or", "in", "on", "at", "for"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))


def month_label(year: Column, month: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    name = F.coalesce(F.try_element_at(names, F.greatest(month.cast("int"), F.lit(1))), month.cast("string"))
    name = F.when(month.between(1, 12), name).otherwise(month.cast("string"))
    return F.concat(name, F.lit(" "), year.cast("string"))


def title_case(text: Column) -> Column:
    """``dso_by_customer`` -> ``DSO by Customer``; NULL -> empty string."""
    words = F.filter(F.split(F.regexp_replace(text, "_", " "), " "), lambda w: w != "")

    def styled(word: Column, position: Column) -> Column:
        return (
            F.when(F.upper(word).isin(ACRONYMS), F.upper(word))
            .when((position > 0) & F.lower(word).isin(CONNECTORS), F.lower(word))
            .otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2**31 - 1))))
        )

    return F.coalesce(F.array_join(F.transform(words, styled), " "), F.lit(""))


def _half_up(value: Column, digits: int = 0) -> Column:
    """Rounded half up and written with exactly that many decimals."""
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def duration_label(millis: Column) -> Column:
    """``580ms``, ``1.4s``, ``28s``, ``1m 5s``; a missing, infinite or negative value is a dash."""
    ms = millis.cast("double")
    seconds = ms / 1000
    bad = ms.isNull() | F.isnan(ms) | (ms == float("inf")) | (ms < 0)
    return (
        F.when(bad, F.lit("—"))
        .when(ms < 1000, F.concat(_half_up(ms), F.lit("ms")))
        .when(seconds < 10, F.concat(_half_up(seconds, 1), F.lit("s")))
        .when(seconds < 60, F.concat(_half_up(seconds), F.lit("s")))
        .otherwise(F.concat(_half_up(F.floor(seconds / 60)), F.lit("m "), _half_up(seconds % 60), F.lit("s")))
    )


def _trimmed(value: Column, digits: int) -> Column:
    """Thousands separators, at most ``digits`` decimals, no trailing zeros."""
    text = F.format_number(F.round(value, digits), digits)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def amount_label(value: Column) -> Column:
    """Cell style: ``$1.25M``, ``$3.4K``, fractions as ``12.5%``, else the plain number."""
    v = value.cast("double")
    return (
        F.when(v.isNull(), F.lit("—"))
        .when(F.abs(v) >= 1_000_000, F.concat(F.lit("$"), _half_up(v / 1_000_000, 2), F.lit("M")))
        .when(F.abs(v) >= 1_000, F.concat(F.lit("$"), _half_up(v / 1_000, 1), F.lit("K")))
        .when((v > 0) & (v < 1), F.concat(_half_up(v * 100, 1), F.lit("%")))
        .otherwise(_trimmed(v, 2))
    )


def axis_label(value: Column) -> Column:
    """Chart style: ``$1.3M``, ``$3K``, else the plain number."""
    v = value.cast("double")
    return (
        F.when(F.abs(v) >= 1_000_000, F.concat(F.lit("$"), _half_up(v / 1_000_000, 1), F.lit("M")))
        .when(F.abs(v) >= 1_000, F.concat(F.lit("$"), _half_up(v / 1_000), F.lit("K")))
        .otherwise(_trimmed(v, 1))
    )


def sentiment_label(sentiment: Column) -> Column:
    return (
        F.when(sentiment == "positive", F.lit("Favorable"))
        .when(sentiment == "negative", F.lit("Unfavorable"))
        .otherwise(F.lit("Neutral"))
    )
