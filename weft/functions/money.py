"""Cost estimates and session grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of the model's name; dollars a million tokens for input, output, cache read, cache write, one-hour
# cache write. The first pattern that matches holds.
RATES = [
    (r"^(?:claude-)?opus-5-5(?:$|-)", 4, 20, 0.2, 5, 8),
    (r"^gpt-6\.1-sol(?:$|-)", 2, 10, 0.1, 2.5, 2.5),
    (r"^gpt-5\.6-sol(?:$|-)", 4, 20, 0.4, 5, 5),
    (r"opus", 15, 75, 1.5, 18.75, 30),
    (r"", 3, 15, 0.3, 3.75, 6),
]


def rate(model: Column, kind: int) -> Column:
    """kind: 0 input, 1 output, 2 cache read, 3 cache write, 4 one-hour cache write."""
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.lit(float(RATES[-1][1 + kind]))
    for pattern, *rates in reversed(RATES[:-1]):
        out = F.when(name.rlike(pattern), float(rates[kind])).otherwise(out)
    return out


def cost(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, cache_write_hour: Column) -> Column:
    """Dollars; ``tokens_in`` includes what the cache read and wrote."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    tokens_in, tokens_out, read, write, hour = map(zero, (tokens_in, tokens_out, cache_read, cache_write, cache_write_hour))
    base = F.greatest(F.lit(0), tokens_in - read - write)
    short = F.greatest(F.lit(0), write - hour)
    return (base * rate(model, 0) + read * rate(model, 2) + tokens_out * rate(model, 1) + short * rate(model, 3) + hour * rate(model, 4)) / 1e6


def long_context_weight(model: Column, tokens_in: Column, output: bool, models: str = r"^gpt-(?:6\.1|5\.6)-sol(?:$|-)", above: int = 272_000) -> Column:
    """Requests beyond ``above`` input tokens are billed twice for input and 1.5 times for output on some models."""
    return F.when((tokens_in > above) & F.lower(F.coalesce(model, F.lit(""))).rlike(models), 1.5 if output else 2.0).otherwise(1.0)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def grade_score(chapters: Column, errors: Column, calls: Column, tokens_in: Column, cache_read: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    chapters, errors, calls, tokens_in, cache_read = map(zero, (chapters, errors, calls, tokens_in, cache_read))
    error = F.greatest(F.lit(0.0), 100 - F.when(calls > 0, errors / calls).otherwise(0) * 250)
    each = errors / F.when(chapters > 0, chapters)
    quality = F.when(each == 0, 100).when(each < 1, 80).when(each < 2, 50).otherwise(20)
    total = tokens_in + cache_read
    cache = F.when(total < 10_000, 75.0).otherwise(F.least(F.lit(100.0), cache_read / F.when(total > 0, total) * 125))
    score = half_up(error * 0.35 + quality * 0.20 + 100 * 0.10 + F.when(errors == 0, 100).otherwise(75) * 0.15 + cache * 0.20)
    return F.when(chapters == 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score))).cast("int")


def grade_letter(chapters: Column, score: Column) -> Column:
    return F.when(F.coalesce(chapters, F.lit(0)) == 0, "-").when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
