"""Column -> Column feature arithmetic (F family, section 2.8).

Guards follow the reference: ``+ 1`` in denominators where it has one,
``try_divide`` where it has none (plain ``/`` raises under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spill_ratio(memory_spill, shuffle_write) -> Column:
    """``fn_spill_ratio``: memory spill / (shuffle write + 1)."""
    return _c(memory_spill) / (_c(shuffle_write) + F.lit(1))


def cpu_efficiency(cpu_time, run_time) -> Column:
    """``fn_cpu_efficiency``: cpu / (runtime + 1), units as the log has them
    (cpu in ns, runtime in ms -- see :func:`cpu_utilization`)."""
    return _c(cpu_time) / (_c(run_time) + F.lit(1))


def cpu_utilization(cpu_ns, run_ms) -> Column:
    """CPU time over run time with both in milliseconds."""
    return F.try_divide(_c(cpu_ns) / F.lit(1e6), _c(run_ms))


def runtime_skew(max_rt, median_rt) -> Column:
    """``fn_runtime_skew``: max / (median + 1)."""
    return _c(max_rt) / (_c(median_rt) + F.lit(1))


def p99_ratio(p99, median_rt) -> Column:
    """``fn_p99_ratio``: p99 / (median + 1)."""
    return _c(p99) / (_c(median_rt) + F.lit(1))


def cardinality_error(actual, estimated) -> Column:
    """``fn_cardinality_error``: actual / (estimated + 1); null estimate -> null."""
    return _c(actual) / (_c(estimated) + F.lit(1))


def log_cardinality(ratio) -> Column:
    """``fn_log_cardinality``: log10(ratio + 1)."""
    return F.log10(_c(ratio) + F.lit(1))


def statistics_issue(ratio, threshold: float = 10.0) -> Column:
    """``pred_statistics_issue``: ratio > threshold, null -> false."""
    return F.coalesce(_c(ratio) > F.lit(threshold), F.lit(False))


def row_amplification(output_rows, input_rows) -> Column:
    """``fn_row_amplification``: output / input rows, no +1 guard."""
    return F.try_divide(_c(output_rows), _c(input_rows))


def risk_scores(partition_skew_ratio="partition_skew_ratio", spill="spill_ratio",
                runtime_skew_ratio="runtime_skew_ratio", gini="gini_coefficient_runtime",
                cpu_eff="cpu_efficiency") -> dict[str, Column]:
    """``fn_risk_scores``: shuffle, skew and memory risk, and their mean with
    cpu efficiency as the overall health score."""
    shuffle = _c(partition_skew_ratio) * _c(spill)
    skew = _c(runtime_skew_ratio) * _c(gini)
    memory = _c(spill) * F.lit(2)
    overall = (F.lit(0.25) * shuffle + F.lit(0.25) * skew + F.lit(0.25) * memory
               + F.lit(0.25) * _c(cpu_eff))
    return {"shuffle_risk_score": shuffle, "skew_severity_score": skew,
            "memory_risk_score": memory, "overall_health_score": overall}


def elapsed(start, end) -> Column:
    """end - start (epoch milliseconds)."""
    return _c(end) - _c(start)
