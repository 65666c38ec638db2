"""Label encodings, category maps, thresholds and shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The three sentiment classes and the label encodings in use.
SENTIMENTS = ("positive", "negative", "neutral")
LABELS_WITH_OFFTOPIC = {"positive": 1, "neutral": 2, "negative": 3, "offtopic": 4}
LABELS_THREE_WAY = {"negative": 0, "neutral": 1, "positive": 2}

# Exact subreddit names with a diet of their own.
CATEGORY_OF_SUBREDDIT = {
    "keto": "keto",
    "vegan": "vegan",
    "paleo": "paleo",
    "intermittentfasting": "intermittentfasting",
    "whole30": "whole30",
}

# Lower-cased subreddit names and their topics.
TOPIC_OF_SUBREDDIT = {
    "keto": "keto",
    "intermittentfasting": "intermittentfasting",
    "plantbaseddiet": "plantbaseddiet",
    "vegan": "plantbaseddiet",
    "vegetarian": "plantbaseddiet",
}
NO_TOPIC = "none"

# Spellings of the off-topic label found in task files.
OFFTOPIC_SPELLINGS = ("off-topic", "offtopic")


def lookup(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """A fixed mapping as one expression; missing keys give ``default`` or null."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    return out if default is None else out.otherwise(default)


def category_of(subreddit: Column) -> Column:
    return lookup(subreddit, CATEGORY_OF_SUBREDDIT)


def topic_of(subreddit: Column) -> Column:
    return lookup(F.lower(subreddit), TOPIC_OF_SUBREDDIT, F.lit(NO_TOPIC))


def by_threshold(score: Column, high: float = 0.05, low: float = -0.05) -> Column:
    """Both thresholds belong to the outer classes."""
    return F.when(score >= high, "positive").when(score <= low, "negative").otherwise("neutral")


def encode(label: Column, mapping: Mapping[str, int] = LABELS_THREE_WAY) -> Column:
    return lookup(label, mapping)


def decode(code: Column, mapping: Mapping[str, int] = LABELS_THREE_WAY) -> Column:
    unknown = F.concat(F.lit("unknown("), code.cast("string"), F.lit(")"))
    return lookup(code, {number: word for word, number in mapping.items()}, unknown)


def canonical_label(label: Column) -> Column:
    return F.when(label.isin(*OFFTOPIC_SPELLINGS), "offtopic").otherwise(label)


def percent(part: Column, total: Column) -> Column:
    """Share in percent to one decimal, half up, 0 for an empty total.

    Integer arithmetic, so no two engines round a tie differently.
    """
    part, total = part.cast("bigint"), total.cast("bigint")
    tenths = F.call_function("div", part * 2000 + total, F.nullif(total * 2, F.lit(0).cast("bigint")))
    return F.coalesce(tenths / F.lit(10.0), F.lit(0.0))
