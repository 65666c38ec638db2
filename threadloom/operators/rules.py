"""Topic rules that correct a sentiment label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import bind

Rules = Mapping[str, Mapping[str, Sequence[Sequence[str]]]]

# All terms of a rule must occur in the lower-cased text.
DOMAIN_RULES: Rules = {
    "keto": {
        "positive": [
            ("fat adapted",), ("ketosis",), ("keto flu gone",), ("energy increase",), ("mental clarity",), ("focus",),
            ("down", "lbs"), ("pounds down",), ("sv",), ("nsv",), ("goal weight",),
            ("bacon", "delicious"), ("butter", "amazing"), ("keto", "tasty"), ("fat bomb",),
            ("inflammation", "gone"), ("pain", "better"), ("diabetes", "improved"), ("blood sugar", "stable"),
        ],
        "negative": [
            ("keto flu",), ("keto rash",), ("electrolyte", "imbalance"), ("leg cramps",), ("kicked out", "ketosis"),
            ("carb", "cravings"), ("plateau",), ("stalled",), ("constipation",), ("bad breath",),
            ("keto", "difficult"), ("too restrictive",),
        ],
    },
    "intermittentfasting": {
        "positive": [
            ("fasting", "easy"), ("autophagy",), ("16:8", "working"), ("omad", "great"), ("hunger", "gone"),
            ("mental clarity",), ("lost", "weight", "fasting"), ("energy", "increased"), ("sleep", "better"),
            ("focus", "improved"), ("if", "amazing"), ("intermittent", "love"), ("24", "hour", "fast"),
            ("48", "hour", "success"), ("extended", "fast", "completed"),
        ],
        "negative": [
            ("hangry",), ("dizzy", "fasting"), ("binge", "eating"), ("broke", "fast", "early"),
            ("hungry", "miserable"), ("fasting", "hard"), ("headache", "fasting"), ("weakness",),
            ("social", "pressure"), ("can't", "fast"), ("giving up", "if"), ("too difficult",),
        ],
    },
    "plantbaseddiet": {
        "positive": [
            ("cholesterol", "dropped"), ("blood pressure", "normal"), ("energy", "amazing"), ("skin", "clear"),
            ("digestion", "better"), ("weight loss",), ("animals", "saved"), ("compassionate",),
            ("environment", "helping"), ("sustainable",), ("cruelty", "free"), ("plant", "power"),
            ("delicious", "plants"), ("whole foods", "amazing"), ("vegetables", "love"), ("fruits", "incredible"),
            ("wfpb", "great"), ("plant based", "easy"),
        ],
        "negative": [
            ("b12", "deficient"), ("iron", "low"), ("protein", "worried"), ("supplements", "expensive"), ("anemia",),
            ("fatigue", "plant"), ("family", "unsupportive"), ("eating out", "hard"), ("expensive", "vegetables"),
            ("time consuming",), ("miss", "meat"), ("cravings", "cheese"), ("bloated", "beans"),
            ("gas", "vegetables"), ("fiber", "too much"), ("stomach", "upset"),
        ],
    },
    "general": {
        "positive": [
            ("weight loss",), ("healthy",), ("goal", "reached"), ("feeling", "great"), ("energy", "up"), ("thanks",),
        ],
        "negative": [
            ("struggling",), ("difficult",), ("frustrated",), ("plateau",), ("giving up",), ("too hard",),
        ],
    },
}
FALLBACK = "general"


def any_rule_matches(text_lower: Column, rules: Sequence[Sequence[str]]) -> Column:
    """True if every term of at least one rule is a substring."""
    if not rules:
        return F.lit(False)
    table = F.array(*[F.array(*[F.lit(term) for term in rule]) for rule in rules])
    return F.exists(table, lambda rule: F.forall(rule, lambda term: F.contains(text_lower, term)))


def _matches(text_lower: Column, topic: Column, polarity: str, rules: Rules) -> Column:
    out = None
    for name, lists in rules.items():
        if name == FALLBACK:
            continue
        hit = any_rule_matches(text_lower, lists.get(polarity, ()))
        out = F.when(topic == name, hit) if out is None else out.when(topic == name, hit)
    rest = any_rule_matches(text_lower, rules.get(FALLBACK, {}).get(polarity, ()))
    return rest if out is None else out.otherwise(rest)


def corrected_label(text: Column, label: Column, topic: Column, rules: Rules = DOMAIN_RULES) -> Column:
    """A positive rule lifts any label but positive; else a negative rule
    lowers any label but negative; empty text keeps its label."""
    label = F.coalesce(label, F.lit("neutral"))
    topic = F.coalesce(topic, F.lit("none"))

    def fixed(lower: Column) -> Column:
        return (
            F.when((label != "positive") & _matches(lower, topic, "positive", rules), "positive")
            .when((label != "negative") & _matches(lower, topic, "negative", rules), "negative")
            .otherwise(label)
        )

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, label).otherwise(bind(F.lower(text), fixed))


def correct(
    df: DataFrame, text: str = "text_content", label: str = "sentiment", topic: str = "topic",
    rules: Rules = DOMAIN_RULES, keep_old: str | None = None,
) -> DataFrame:
    """Replace ``label`` by its corrected value, optionally keeping the old one."""
    fixed = corrected_label(F.col(text), F.col(label), F.col(topic), rules)
    if keep_old:
        df = df.withColumn(keep_old, F.col(label))
    return df.withColumn(label, fixed)


def change_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    """How many rows there are and how many labels changed."""
    changed = ~F.col(old).eqNullSafe(F.col(new))
    return df.agg(F.count("*").alias("objects"), F.count(F.when(changed, 1)).alias("corrections"))
