"""Gates over experiment rows: rules as columns, decisions as structs, reasons as filtered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(cond, F.lit(text)) for cond, text in rules)), lambda x: x.isNotNull())


def quantization_gate(full: Column, quantized: Column, baseline: Column, least_ratio: float = 0.8, least_gain: float = 0.0) -> dict[str, Column]:
    """Gains, retained ratio, passed, reasons; a gain that is not over the minimum fails."""
    gain, low = full - baseline, quantized - baseline
    small = gain <= least_gain
    ratio = F.when(small, F.when(low >= gain, 1.0).otherwise(0.0)).otherwise(low / gain)
    reasons = listed((small, "fp32_gain_below_minimum"), (ratio < least_ratio, "retained_gain_below_threshold"), (low < 0, "quantized_fitness_below_baseline"))
    return {"full_gain": gain, "quantized_gain": low, "retained_ratio": ratio, "passed": ~small & (ratio >= least_ratio), "reasons": reasons}


def behaviour(profile: Column, baseline: Column, delta: Column, active: Column, epsilon: float = 0.001) -> tuple[Column, Column]:
    """Class and severity of a profile's behaviour."""
    kind = (
        F.when(profile == baseline, "reference")
        .when(~active & (F.abs(delta) <= epsilon), "no_op_tied")
        .when(~active, "metric_changed_without_actuator")
        .when(delta > epsilon, "actuator_active_positive")
        .when(delta < -epsilon, "actuator_active_negative")
        .otherwise("actuator_active_neutral")
    )
    severity = F.when(kind == "metric_changed_without_actuator", "high").when(kind == "actuator_active_negative", "medium").when(kind == "actuator_active_neutral", "low").otherwise("none")
    return kind, severity


def health(collapse: Column, isomer: Column, topology: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted complements of ratios bounded to [0, 1]."""
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return sum((w / sum(weights) * (1.0 - bounded(x)) for w, x in zip(weights, (collapse, isomer, topology), strict=True)), F.lit(0.0))


def health_class(collapse: Column, oscillation: Column, covalent_change: Column, isomer: Column) -> Column:
    """critical, degrading or healthy: the worst of the signals that are there."""
    over = lambda c, x: F.coalesce(c > x, F.lit(False))
    critical = over(collapse, 0.5) | over(covalent_change, 0.1) | over(isomer, 0.6)
    degrading = over(collapse, 0.2) | over(oscillation, 0.005) | over(covalent_change, 0.05) | over(isomer, 0.3)
    return F.when(critical, "critical").when(degrading, "degrading").otherwise("healthy")


def penalty(score: Column, weight: float = 0.5) -> Column:
    """Multiplier max(0, 1 - weight * (1 - score))."""
    return F.greatest(F.lit(0.0), 1.0 - weight * (1.0 - score))


def adaptive_gate(fitness: Column, score: Column, quantized_passed: Column, latency: Column, ratio: Column, route_jaccard: Column, least_fitness: float, least_health: float, most_latency: float, needs_quantized: bool = False) -> dict[str, Column]:
    """Actions, reasons and status of the advisory rules; a missing measurement triggers nothing."""
    failed_fitness = F.coalesce(fitness < least_fitness, F.lit(False))
    unhealthy = F.coalesce(score < least_health, F.lit(False))
    unquantized = F.coalesce(~quantized_passed, F.lit(False))
    slow = F.coalesce(latency > most_latency, F.lit(False))
    off = F.coalesce((ratio < 0.5) | (ratio > 2.0), F.lit(False))
    watch = F.coalesce(~off & ((ratio < 0.75) | (ratio > 1.33)), F.lit(False))
    weak = F.coalesce(route_jaccard < 0.25, F.lit(False))
    actions = listed(
        (failed_fitness, "reject_candidate"), (unhealthy, "reduce_optimization_aggression"), (unhealthy, "enable_query_reformulation"), (unquantized, "reject_quantized_candidate"),
        (slow, "apply_storage_latency_penalty"), (off, "normalize_runtime_vectors"), (watch, "inspect_norm_drift"), (weak, "disable_low_effectiveness_route"),
    )
    reasons = listed(
        (failed_fitness, "final_fitness_below_minimum"), (unhealthy, "structural_health_below_threshold"), (unquantized, "quantization_gate_failed"), (slow, "storage_latency_sla_exceeded"),
        (off, "adapter_norm_ratio_out_of_band"), (watch, "adapter_norm_ratio_watch_band_exceeded"), (weak, "route_effectiveness_below_threshold"),
    )
    failed = failed_fitness | (unquantized if needs_quantized else F.lit(False))
    return {"actions": actions, "reasons": reasons, "status": F.when(failed, "fail").when(F.size(actions) > 0, "warning").otherwise("pass")}


def holds(feature: Column, op: Column, cut: Column) -> Column:
    """``feature op cut`` with op ``<=``, ``>=`` or ``<``; false for a missing feature."""
    return F.coalesce(F.when(op == "<=", feature <= cut).when(op == ">=", feature >= cut).when(op == "<", feature < cut), F.lit(False))


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(score, F.lit(-40.0)), F.lit(40.0))))
