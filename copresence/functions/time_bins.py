"""Half-hour bins of stays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bin_of(hour: Column, groups: int = 48) -> Column:
    """1-based bin of a decimal hour; bins are (a, b], the first one also holds 0."""
    return F.greatest(F.lit(1), F.ceil(hour * groups / 24)).cast("int")


def stay_span(h_s: Column, dur: Column, groups: int = 48) -> Column:
    """Ranges of bins a stay covers; what runs past midnight wraps to bin 1 and comes first."""
    end = h_s + dur / 60
    main = F.struct(bin_of(h_s, groups).alias("lo"), bin_of(F.least(end, F.lit(24.0)), groups).alias("hi"))
    wrap = F.struct(F.lit(1).alias("lo"), bin_of(end - 24, groups).alias("hi"))
    return F.when(end > 24, F.array(wrap, main)).otherwise(F.array(main))


def span_bins(span: Column) -> Column:
    """The bins of a span as one array."""
    first, second = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    whole = F.sequence(first["lo"], first["hi"])
    return F.when(second.isNotNull(), F.concat(whole, F.sequence(second["lo"], second["hi"]))).otherwise(whole)


def span_length(span: Column) -> Column:
    """Number of bins a span covers, counted without building them."""
    first, second = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    tail = F.coalesce(second["hi"] - second["lo"] + 1, F.lit(0))
    return (first["hi"] - first["lo"] + 1 + tail).cast("int")


def explode_bins(df: DataFrame, span: str = "time_span", out: str = "time_seq") -> DataFrame:
    """One row per stay and bin."""
    return df.withColumn(out, F.explode(span_bins(F.col(span)))).drop(span)


def profile_range(h_s: Column, dur: Column, interval: int = 30, days: int = 2, start_unit: str = "hours"):
    """First and last 0-based profile bin of a stay, both inside a holder of `days` days.

    start_unit "hours_raw" reads the hour as if it were minutes, the slip of the published numbers.
    """
    minutes = h_s if start_unit == "hours_raw" else h_s * 60
    last = int(days * 24 * 60 / interval) - 1
    whole = F.floor(dur).cast("int")
    lo = F.floor(minutes / interval).cast("int")
    hi = F.least(F.floor((minutes + whole) / interval).cast("int"), F.lit(last))
    return lo, hi
