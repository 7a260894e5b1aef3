"""Scores and states of stories, situations, sources and signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import CONFIRMED_DAYS, GATHERING_HOURS, NEED_DAYS, NOTICE_DAYS


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hours_between(then: Column, now: Column) -> Column:
    """Whole hours, toward zero for ages."""
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))) / 3600)


def days_between(then: Column, now: Column) -> Column:
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))) / 86400)


def unexpired(node_type: Column, starts_at: Column, ends_at: Column, recurring: Column, extracted_at: Column, confirmed_at: Column, now: Column) -> Column:
    """Gatherings until a week after their end, needs and notices by their age, all else by its last confirmation."""
    age = lambda t: F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))
    gathering = recurring | starts_at.isNull() | (age(F.coalesce(ends_at, starts_at)) <= GATHERING_HOURS * 3600)
    return (
        F.when(node_type == "Gathering", gathering)
        .when(node_type == "Need", age(extracted_at) <= NEED_DAYS * 86400)
        .when(node_type == "Notice", age(extracted_at) <= NOTICE_DAYS * 86400)
        .otherwise(age(confirmed_at) <= CONFIRMED_DAYS * 86400)
    )


def recency(then: Column, now: Column, days: float = 14.0) -> Column:
    """One today, zero from ``days`` on; null times are stale."""
    return F.coalesce(clamp(1.0 - (hours_between(then, now) / 24.0) / days), F.lit(0.0))


def story_status(types: Column, entities: Column, signals: Column) -> Column:
    return F.when((types == 1) & (signals >= 5), "echo").when((entities >= 2) & (types >= 2), "confirmed").otherwise("emerging")


def story_energy(velocity: Column, recent: Column, sources: Column, types: Column, channels: Column, status: Column) -> Column:
    channel = F.when(status == "echo", 0.0).otherwise(clamp((channels - 1) / 3.0))
    return velocity * 0.4 + recent * 0.2 + F.least(sources / 5.0, F.lit(1.0)) * 0.1 + F.least(types / 5.0, F.lit(1.0)) * 0.2 + channel * 0.1


def story_arc(velocity: Column, age_days: Column, was_fading: Column) -> Column:
    return (
        F.when(was_fading & (velocity > 0), "resurgent").when(age_days < 7, "emerging").when(velocity > 0.5, "growing").when(velocity <= -0.3, "fading").otherwise("stable")
    )


def zombie(age_days: Column, velocity: Column) -> Column:
    return (age_days > 30) & (velocity <= 0)


def temperature(heat: Column, velocity: Column, gap: Column, amplification: Column, clarity_need: Column) -> Column:
    return 0.30 * heat + 0.25 * velocity + 0.15 * gap + 0.15 * amplification * F.least(heat + velocity, F.lit(1.0)) + 0.15 * clarity_need


def clarity_score(support: Column, diversity: Column) -> Column:
    return F.least(support / 3.0, F.lit(1.0)) * F.least(diversity / 2.0, F.lit(1.0))


def clarity_need(support: Column, diversity: Column, stale_days: Column) -> Column:
    """What is missing to a clear thesis, fading from 30 to 90 days without new signals."""
    fade = F.when(stale_days > 30, F.greatest(1.0 - (stale_days - 30) / 60.0, F.lit(0.0))).otherwise(1.0)
    return clamp((1.0 - clarity_score(support, diversity)) * fade)


def clarity(support: Column, diversity: Column) -> Column:
    s = clarity_score(support, diversity)
    return F.when(s < 0.3, "fuzzy").when(s < 0.7, "sharpening").otherwise("sharp")


def situation_arc(heat: Column, age_hours: Column, before: Column) -> Column:
    return (
        F.when((before == "cold") & (heat >= 0.3), "developing")
        .when(heat < 0.1, "cold")
        .when(heat < 0.3, "cooling")
        .when(age_hours < 72, "emerging")
        .when(heat < 0.6, "developing")
        .otherwise("active")
    )


def echo_score(types: Column, entities: Column, signals: Column) -> Column:
    share = F.least(types / signals, F.lit(1.0)) * F.least(entities / signals, F.lit(1.0))
    return F.when(signals <= 1, 0.0).otherwise(1.0 - F.sqrt(share))


def source_weight(signals: Column, corroborated: Column, scrapes: Column, tensions: Column, days_since: Column) -> Column:
    """Smoothed yield, raised by tensions and corroboration, lowered by silence."""
    got = F.when(scrapes > 0, F.least(signals / scrapes, F.lit(1.0))).otherwise(0.0)
    base = F.when(scrapes < 5, (got * scrapes + 0.3 * 3.0) / (scrapes + 3.0)).otherwise(got)
    tension = F.when(signals > 0, F.least(1.0 + tensions / signals, F.lit(2.0))).otherwise(1.0)
    silence = F.when(days_since.isNull(), 0.7).when(days_since < 30, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (days_since - 30) / 60.0))
    diverse = F.when((signals > 0) & (corroborated > 0), 1.0 + F.least(corroborated / signals * 0.5, F.lit(0.5))).otherwise(1.0)
    return clamp(base * tension * silence * diverse, 0.1, 1.0)


def cadence_hours(weight: Column) -> Column:
    return F.when(weight > 0.8, 6).when(weight > 0.5, 24).when(weight > 0.2, 72).otherwise(168)


def dormancy(method: Column) -> Column:
    return F.when(method.isin("social_graph_follow", "linked_from"), 3).otherwise(5)


def cadence_with_backoff(weight: Column, empty_runs: Column, method: Column) -> Column:
    """Cadence doubled for the second, third and fourth empty run; null for a dormant source."""
    times = F.when(empty_runs <= 1, 1).when(empty_runs == 2, 2).when(empty_runs == 3, 4).when(empty_runs == 4, 8)
    return F.when(empty_runs < dormancy(method), cadence_hours(weight) * times)


def initial_weight(method: Column, gap: Column) -> Column:
    return (
        F.when(method.isin("curated", "human_submission"), 0.5)
        .when((method == "gap_analysis") & (gap == "unmet_tension"), 0.4)
        .when(method.isin("signal_expansion", "social_graph_follow"), 0.2)
        .when(method == "linked_from", 0.25)
        .otherwise(0.3)
    )


def quality_penalty(open_issues: Column) -> Column:
    return F.greatest(F.lit(0.1), 1.0 - 0.15 * open_issues)


def confidence_step(direct: Column, supporting: Column, contradicting: Column) -> Column:
    """Change of a confidence by counts of evidence: capped gains, uncapped losses."""
    return F.least(direct * 0.05, F.lit(0.15)) + F.least(supporting * 0.02, F.lit(0.06)) - contradicting * 0.10


def geo_score(accuracy: Column) -> Column:
    return F.when(accuracy == "high", 1.0).when(accuracy == "medium", 0.7).otherwise(0.3)


def extraction_confidence(completeness: Column, accuracy: Column) -> Column:
    return clamp(completeness * 0.5 + geo_score(accuracy) * 0.5)


def backoff_days(misses: Column) -> Column:
    return F.when(misses <= 0, 7).when(misses == 1, 14).when(misses == 2, 21).otherwise(30)
