"""Activation arithmetic: lazy decay, novelty, state and retrieval scores, feedback and the softmax choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_heat(heat: Column, tick: Column, last: Column, half_life: float) -> Column:
    return F.greatest(F.lit(0.0), heat * F.pow(F.lit(0.5), F.greatest(F.lit(0), tick - last) / F.lit(float(half_life))))


def novelty(best: Column) -> Column:
    """1 - best similarity, within [0, 1]; 1 where there is nothing to be similar to."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(best, F.lit(-2.0))))))


def state_score(mass: Column, familiarity: Column, heat: Column) -> Column:
    return F.coalesce(0.55 * mass / (mass + 5) + 0.30 * familiarity + 0.15 * heat / (heat + 3), F.lit(0.0))


def retrieval_score(similarity: Column, dynamic: Column, weight: float = 0.05) -> Column:
    if not 0 <= weight <= 0.25:
        raise ValueError("weight must be within [0, 0.25]")
    return (1 - weight) * similarity + weight * dynamic


def familiarity_after(before: Column, strengths: Column, gain: float = 0.08) -> Column:
    """Feedback one after another closes a share of what is missing each time: a product over the group's strengths."""
    return 1 - (1 - before) * F.exp(F.sum(F.log(1 - gain * F.greatest(F.lit(0.0), F.least(F.lit(1.0), strengths)))))


def choice_probability(delta: Column, gamma: float = 1.0, tau: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-gamma * delta / tau))
