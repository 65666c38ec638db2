"""Lexicon sentiment: one compound score in [-1, 1] per text.

The adjustments follow Hutto & Gilbert (2014): degree words, negation within
three words, a contrast word, capitals, punctuation, and phrases. Every number
and word list is a parameter of ``Scheme``; the lexicon is an input table
(token, valence).

With ``Scheme.phrases`` (the default) a word's value goes through the published
steps one by one: nearest word before it first, degree added, then negation; then
idioms and degree phrases; then "least". Words of the lexicon neither strengthen
nor negate. Without phrases degrees are added up and negations multiplied at once,
and degree words of the lexicon don't count as such.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.labels import by_threshold
from threadloom.functions.text import bind, null_text
from threadloom.session import settle

# Rows up to which a lexicon is broadcast.
BROADCAST_ENTRIES = 100_000
# Contributions are summed as whole units, so the order of words cannot matter.
UNITS = 1_000_000_000

# The ASCII punctuation marks.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


# The degree words and negations that Hutto & Gilbert (2014) published with their scheme, in their order.
# Entries of two words are degree phrases.
STRONGER = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "effing",
    "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely",
    "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully",
    "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible", "incredibly",
    "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually",
    "utter", "utterly", "very",
)
WEAKER = (
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal",
    "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of",
    "sorta", "sortof", "sort-of",
)
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't", "couldn't",
    "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "don't",
    "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't", "never", "none", "nope", "nor",
    "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't",
    "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom",
    "despite",
)

# The idioms that were published with a value of their own.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}


def _strengths(up: Sequence[str], down: Sequence[str], step: float = 0.293) -> dict[str, float]:
    return {**{w: step for w in up}, **{w: -step for w in down}}


@dataclass(frozen=True)
class Phrases:
    """Rules on several words in a row, all replaceable.

    An idiom of up to three words gives its value to a word in it, or right or
    one word before it. "Never so" and "never this" strengthen, "without doubt"
    doesn't negate, "least" negates unless "at" or "very" stand before it, "no"
    negates and has no value before a word of the lexicon.
    """

    idioms: Mapping[str, float] = field(default_factory=lambda: dict(IDIOMS))
    never: str = "never"
    so: Sequence[str] = ("so", "this")
    strengthened: float = 1.25
    without: str = "without"
    doubt: str = "doubt"
    least: str = "least"
    spared: Sequence[str] = ("at", "very")
    no: str = "no"
    alternatives: Sequence[str] = ("or", "nor")
    # A word without a value before the other one: part of a degree phrase.
    unvalued: tuple[str, str] = ("kind", "of")
    contraction: str = "n't"


@dataclass(frozen=True)
class Scheme:
    """Fixed values of the scoring scheme, all replaceable."""

    boosters: Mapping[str, float] = field(default_factory=lambda: _strengths(STRONGER, WEAKER))
    negators: Sequence[str] = NEGATORS
    contrast: Sequence[str] = ("but",)
    damping: Sequence[float] = (1.0, 0.95, 0.9)
    negation: float = -0.74
    capitals: float = 0.733
    before_contrast: float = 0.5
    after_contrast: float = 1.5
    exclamation: float = 0.292
    exclamations: int = 4
    question: float = 0.18
    questions: int = 3
    many_questions: float = 0.96
    alpha: float = 15.0
    phrases: Phrases | None = field(default_factory=Phrases)


DEFAULT_SCHEME = Scheme()


_MARKS = "[" + "".join("\\" + mark for mark in PUNCTUATION) + "]"
_INNER = "[^" + "".join("\\" + mark for mark in PUNCTUATION) + "\\s]"
_DRESSED = rf"(?<![^\s]){_MARKS}*({_INNER}[^\s]+{_INNER}){_MARKS}*(?![^\s])"


def bare_words(text: Column) -> Column:
    """The text with blanks for white space and no punctuation around words.

    A word of two characters or fewer keeps its marks, so emoticons survive.
    One pattern over the whole text is cheaper than one call per word.
    """
    return F.translate(F.regexp_replace(text, _DRESSED, "$1"), "\t\n\r\f\x0b", "     ")


def split_words(bare: Column) -> Column:
    return F.array_remove(F.split(bare, " "), "")


def _all_capitals(token: Column) -> Column:
    return (token == F.upper(token)) & (token != F.lower(token))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _sets(col: Column, groups: Mapping[float, Sequence[str]], default: float | None) -> Column:
    out = None
    for value, members in groups.items():
        hit = col.isin(list(members))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _by_value(mapping: Mapping[str, float]) -> dict[float, list[str]]:
    groups: dict[float, list[str]] = {}
    for token, value in sorted(mapping.items()):
        groups.setdefault(value, []).append(token)
    return groups


def _first_contrast(bare: Column, scheme: Scheme) -> Column:
    """Number of words before the first contrast word; null if there is none."""
    padded = F.concat(F.lit(" "), F.lower(bare), F.lit(" "))
    places = [F.nullif(F.instr(padded, f" {word} "), F.lit(0)) for word in scheme.contrast]
    if not places:
        return F.lit(None).cast("int")
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNotNull(), F.size(split_words(F.left(padded, first))))


def _mixed_case(text: Column) -> Column:
    """True unless every word has capitals and no small letters."""
    return F.when(text != F.upper(text), True).otherwise(F.rlike(text, F.lit(r"(?<![^\s])[^\p{Lu}\s]+(?![^\s])")))


def _contribution(
    value: Column, token: Column, at: Column, before: Sequence[Column], boosters: Mapping[str, float], scheme: Scheme
) -> Column:
    """Whole units one lexicon word adds, given the words before it."""
    sign = F.signum(value)
    groups = _by_value(boosters)
    out = value
    for word, weight in zip(before, scheme.damping):
        damped = {inc * weight: members for inc, members in groups.items()}
        out = out + sign * F.when(word.isNotNull(), _sets(word, damped, 0.0)).otherwise(F.lit(0.0))
    out = out + sign * F.when(F.col("_mixed") & _all_capitals(token), F.lit(scheme.capitals)).otherwise(F.lit(0.0))
    flips = None
    for word in before:
        flip = F.when(word.isin(list(scheme.negators)), 1).otherwise(0)
        flips = flip if flips is None else flips + flip
    factor = F.lit(1.0)
    for n in range(len(before), 0, -1):
        factor = F.when(flips == n, F.lit(scheme.negation**n)).otherwise(factor)
    return _whole_units(out * factor, at, scheme)


def _whole_units(value: Column, at: Column, scheme: Scheme) -> Column:
    side = (
        F.when(at < F.col("_turn"), F.lit(scheme.before_contrast))
        .when(at > F.col("_turn"), F.lit(scheme.after_contrast))
        .otherwise(F.lit(1.0))
    )
    return F.floor(value * side * float(UNITS) + 0.5).cast("bigint")


def _found(word: Column, members: Sequence[str]) -> Column:
    """Whether the word is one of the members; a missing word is none."""
    return F.coalesce(word.isin(list(members)), F.lit(False)) if members else F.lit(False)


def _step(value: Column, distance: int, weight: float, scheme: Scheme) -> Column:
    """The value of a hit after the word at a distance before it: its degree is added, then it may negate."""
    rules = scheme.phrases
    before = [F.col(f"_low_before{d}") for d in range(1, distance + 1)]
    own, shown = before[-1], F.col(f"_before{distance}")
    degree = _sets(own, _by_value({w: x for w, x in scheme.boosters.items() if " " not in w}), 0.0)
    degree = F.when(own.isNotNull(), degree).otherwise(F.lit(0.0))
    shouted = F.col("_mixed") & _all_capitals(shown)

    def loud(v: Column) -> Column:
        return F.when(shouted, F.when(v > 0, scheme.capitals).otherwise(-scheme.capitals)).otherwise(F.lit(0.0))

    def added(v: Column, x: Column) -> Column:
        return F.when(x != 0, (F.when(v < 0, -x).otherwise(x) + loud(v)) * weight).otherwise(F.lit(0.0))

    negated = _found(own, scheme.negators) | F.coalesce(F.contains(own, F.lit(rules.contraction)), F.lit(False))

    def turned(raised: Column) -> Column:
        out = F.when(negated, raised * scheme.negation).otherwise(raised)
        between = before[:-1]
        if between:
            so = _found(own, [rules.never]) & _found(between[-1], rules.so)
            if distance > 2:
                # As published: at this distance "so" or "this" right before the word is enough.
                so = so | _found(before[0], rules.so)
            doubt = _found(between[0], [rules.doubt])
            for word in between[1:]:
                doubt = doubt | _found(word, [rules.doubt])
            out = F.when(so, raised * rules.strengthened).when(_found(own, [rules.without]) & doubt, raised).otherwise(out)
        return out

    counts = own.isNotNull() & ~F.col(f"_known{distance}")
    return bind(value, lambda v: F.when(counts, bind(v + bind(degree, lambda x: added(v, x)), turned)).otherwise(v))


def _of_idioms(value: Column, scheme: Scheme) -> Column:
    """The value of an idiom around the hit, and degree phrases before it; only after three words, as published."""
    word = {0: F.col("token")}
    word |= {-d: F.col(f"_low_before{d}") for d in (1, 2, 3)} | {d: F.col(f"_low_after{d}") for d in (1, 2)}

    def phrase(first: int, last: int) -> Column:
        # Null if a word is missing.
        return F.concat(*[c for at in range(first, last + 1) for c in ((F.lit(" "),) if at > first else ()) + (word[at],)])

    def valued(place: tuple[int, int], table: Mapping[str, float], default: Column) -> Column:
        """The value of the words at the place, which are put together once."""
        if not table:
            return default
        return F.coalesce(bind(phrase(*place), lambda p: _sets(p, _by_value(table), None)), default)

    def first_match(places: Sequence[tuple[int, int]], default: Column) -> Column:
        for place in reversed(places):
            default = valued(place, scheme.phrases.idioms, default)
        return default

    # Of phrases that begin with the hit the longer one counts, then the shorter one, then those that end with or before it.
    idiom = first_match([(0, 2), (0, 1), (-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)], value)
    degrees = {w: x for w, x in scheme.boosters.items() if " " in w}
    for place in ((-3, -1), (-3, -2), (-2, -1)):
        idiom = idiom + valued(place, degrees, F.lit(0.0))
    counts = F.col("_before3").isNotNull() & ~F.col("_known3")
    return F.when(counts, idiom).otherwise(value)


def _published(hits: DataFrame, lexicon: DataFrame, small: bool, scheme: Scheme) -> tuple[DataFrame, Column]:
    """Hits with all that the published steps need, and the whole units each of them adds.

    The steps are one bound expression. As a column each they made up one
    generated method of 24 KB, and the JVM leaves methods above 8 KB uncompiled.
    """
    rules = scheme.phrases
    around = [f"_before{d}" for d in (1, 2, 3)] + ["_after1", "_after2"]
    hits = hits.select("*", *[F.lower(F.col(name)).alias(f"_low{name}") for name in around])
    # Whether the words around a hit are in the lexicon; where there is none, the row's number stands in for it.
    for name, flag in [(f"_before{d}", f"_known{d}") for d in (1, 2, 3)] + [("_after1", "_known_after")]:
        key = F.coalesce(F.col(f"_low{name}"), F.concat(F.lit("\0"), F.col("_row").cast("string")))
        known = lexicon.select(F.col("token").alias("_key"), F.lit(True).alias(flag))
        hits = hits.withColumn("_key", key).join(F.broadcast(known) if small else known, "_key", "left").drop("_key")
        hits = hits.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    before = {d: F.col(f"_low_before{d}") for d in (1, 2, 3)}
    token, valence = F.col("token"), F.col("valence")
    no = _found(before[1], [rules.no]) | _found(before[2], [rules.no])
    no = no | (_found(before[3], [rules.no]) & _found(before[1], rules.alternatives))
    value = F.when(no, valence * scheme.negation).when(_found(token, [rules.no]) & F.col("_known_after"), F.lit(0.0)).otherwise(valence)
    shouted = F.col("_mixed") & _all_capitals(F.col("_shown"))
    value = bind(value, lambda v: v + F.when(shouted, F.when(v > 0, scheme.capitals).otherwise(-scheme.capitals)).otherwise(F.lit(0.0)))
    for distance, weight in enumerate(scheme.damping, start=1):
        value = _step(value, distance, weight, scheme)
    value = bind(value, lambda v: _of_idioms(v, scheme))
    least = _found(before[1], [rules.least]) & ~F.col("_known1") & ~_found(before[2], rules.spared)
    value = bind(value, lambda v: F.when(least, v * scheme.negation).otherwise(v))
    silent = _found(token, list(scheme.boosters)) | (_found(token, rules.unvalued[:1]) & _found(F.col("_low_after1"), rules.unvalued[1:]))
    hits = hits.withColumn("_value", F.when(silent, F.lit(0.0)).otherwise(value))
    return hits, _whole_units(F.col("_value"), F.col("_at"), scheme)


def _emphasis(text: Column, scheme: Scheme) -> Column:
    """What exclamation and question marks add to a score, whatever its sign."""
    loud = F.least(_count(text, "!"), F.lit(scheme.exclamations)) * scheme.exclamation
    asks = _count(text, "?")
    asking = (
        F.when(asks > scheme.questions, F.lit(scheme.many_questions))
        .when(asks > 1, asks * scheme.question)
        .otherwise(F.lit(0.0))
    )
    return loud + asking


def _compound(units: Column, emphasis: Column, scheme: Scheme) -> Column:
    total = F.coalesce(units, F.lit(0).cast("bigint")).cast("double") / float(UNITS)
    stressed = total + F.signum(total) * emphasis
    return F.round(stressed / F.sqrt(stressed * stressed + scheme.alpha), 4)


def score_texts(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    out: str = "compound",
    scheme: Scheme = DEFAULT_SCHEME,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """Add the compound score of ``text_col``; a null text scores 0.

    ``df`` is read once. A text's words are exploded behind one marker row that
    carries the row's other columns. Words that the lexicon doesn't have go;
    what is left is summed by row, first inside the task that read the text, and
    one row per text is shuffled. Rows are told apart by a number, not by their
    content, so ids may repeat or be missing and copies of a text are no hot key.

    The lexicon is broadcast up to ``broadcast_entries`` rows. A bigger one joins
    by shuffle; adaptive execution splits the partitions of frequent words.
    Columns that the result doesn't use stay out of the shuffle.
    """
    lexicon, boosters, small = _prepared(lexicon, scheme, broadcast_entries)
    kept = [c for c in df.columns if c != out]
    own = {f"_own{i}": F.col(f"`{c}`") for i, c in enumerate(kept)}
    reach, ahead = range(1, len(scheme.damping) + 1), range(1, 3 if scheme.phrases else 1)
    text, words = F.col("_text"), F.col("_words")
    rows = df.select(*[c.alias(n) for n, c in own.items()], null_text(F.col(text_col)).alias("_text"))
    rows = rows.select(
        *own, F.monotonically_increasing_id().alias("_row"), "_text", _emphasis(text, scheme).alias("_emphasis"),
        bare_words(text).alias("_bare"),
    )
    # Each word travels with the words before it, so that no row carries a whole
    # text; the arrays reach past the end, where the outer explode gives nulls.
    none = F.array(F.lit(None).cast("string"))
    split = rows.select(
        *own, "_row", "_emphasis", F.concat(none, split_words(F.col("_bare"))).alias("_words"),
        _first_contrast(F.col("_bare"), scheme).alias("_turn"), _mixed_case(text).alias("_mixed"),
    )
    shifted = [F.concat(*[none] * d, words).alias(f"_before{d}") for d in reach]
    # A zip reaches as far as its longest array, here the words after the last one; they have no word and go.
    shifted += [F.slice(words, d + 1, F.size(words)).alias(f"_after{d}") for d in ahead]
    placed = split.select(
        *own, "_row", "_emphasis", "_turn", "_mixed", F.posexplode_outer(F.arrays_zip(words, *shifted)).alias("_at", "_place")
    )
    marker = F.col("_at") == 0
    shown = placed.select(
        *[F.when(marker, F.col(n)).alias(n) for n in own], "_row", F.when(marker, F.col("_emphasis")).alias("_emphasis"),
        marker.alias("_marker"), "_turn", "_mixed", (F.col("_at") - 1).alias("_at"), F.col("_place._words").alias("_shown"),
        *[F.col(f"_place._before{d}") for d in reach], *[F.col(f"_place._after{d}") for d in ahead],
    ).withColumn("token", F.lower("_shown"))
    shown = shown.where("_marker or token is not null")
    hits = shown.join(F.broadcast(lexicon) if small else lexicon, "token", "left").where("_marker or valence is not null")
    # The words around are looked at for hits only.
    if scheme.phrases:
        hits, amount = _published(hits, lexicon, small, scheme)
    else:
        before = [F.lower(F.col(f"_before{d}")) for d in reach]
        amount = _contribution(F.col("valence"), F.col("_shown"), F.col("_at"), before, boosters, scheme)
    sums = hits.groupBy("_row").agg(
        F.sum(amount).alias("_units"), F.max("_emphasis").alias("_emphasis"),
        *[F.any_value(n, F.lit(True)).alias(n) for n in own],
    )
    score = _compound(F.col("_units"), F.col("_emphasis"), scheme)
    return sums.select(*[F.col(n).alias(c) for n, c in zip(own, kept)], score.alias(out))


def _prepared(lexicon: DataFrame, scheme: Scheme, broadcast_entries: int) -> tuple[DataFrame, dict[str, float], bool]:
    """The lexicon without repeats, the degree words that aren't in it, and whether it is small."""
    lexicon = (
        lexicon.where(F.col("token").isNotNull()).groupBy("token")
        .agg(F.max(F.col("valence").cast("double")).alias("valence"))
    ).where("valence is not null")
    rows = lexicon.limit(broadcast_entries + 1).collect()
    small = len(rows) <= broadcast_entries
    if small:
        known = {r["token"] for r in rows}
        lexicon = lexicon.sparkSession.createDataFrame(rows, "token string, valence double")
    else:
        lexicon = settle(lexicon, "lexicon")
        known = {r["token"] for r in lexicon.where(F.col("token").isin(list(scheme.boosters))).select("token").collect()}
    return lexicon, {w: v for w, v in scheme.boosters.items() if w not in known}, small


def add_sentiment(
    df: DataFrame, text_col: str, lexicon: DataFrame, high: float = 0.05, low: float = -0.05,
    scheme: Scheme = DEFAULT_SCHEME, prefix: str = "vader",
) -> DataFrame:
    """Compound score and its class, as ``<prefix>_compound`` and ``<prefix>_sentiment``."""
    scored = score_texts(df, text_col, lexicon, f"{prefix}_compound", scheme)
    return scored.withColumn(f"{prefix}_sentiment", by_threshold(F.col(f"{prefix}_compound"), high, low))
