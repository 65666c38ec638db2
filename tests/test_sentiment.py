"""The joined scorer against a plain word-by-word version."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from threadloom.operators.rules import DOMAIN_RULES, corrected_label
from threadloom.operators.sentiment import Scheme, add_sentiment, score_texts
from threadloom.session import setting

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "awful": -2.0, ":)": 2.0, "very": 0.4, "ok": 0.9}
SCHEME = Scheme(phrases=None)
PUBLISHED = Scheme()


def by_hand(text):
    words = []
    for raw in (text or "").split():
        bare = raw.strip(string.punctuation)
        words.append(bare if len(bare) > 2 else raw)
    low = [w.lower() for w in words]
    capitals = [w == w.upper() and w != w.lower() for w in words]
    turn = min((i for i, w in enumerate(low) if w in SCHEME.contrast), default=None)
    total = 0
    for i, word in enumerate(low):
        if word not in LEXICON:
            continue
        value = LEXICON[word]
        sign = math.copysign(1, value)
        amount, flips = value, 0
        for d, weight in enumerate(SCHEME.damping, start=1):
            before = low[i - d] if i >= d else None
            if before not in LEXICON:
                amount += sign * (SCHEME.boosters.get(before, 0.0) * weight)
            flips += before in SCHEME.negators
        if capitals[i] and not all(capitals):
            amount += sign * SCHEME.capitals
        amount *= SCHEME.negation**flips
        if turn is not None and i != turn:
            amount *= 0.5 if i < turn else 1.5
        total += math.floor(amount * 1e9 + 0.5)
    x = total / 1e9
    if x:
        asks = (text or "").count("?")
        extra = min((text or "").count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0)
        x += math.copysign(extra, x)
    return round(x / math.sqrt(x * x + 15), 4)


FIXED = [
    None, "", "   ", "good", "GOOD", "GOOD day", "GOOD 123", "not good", "not very good!", "never so good but bad?? maybe???",
    "good\tday\n(great)...", ":) :)", "but good", "good but", "very good", "GREAT!!!!!! AWFUL", "barely ok", "isn't awful", "good,bad", "'good' \"bad\"",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    pool = [*LEXICON, *list(SCHEME.boosters)[:6], "not", "never", "but", "day", "I", "x", "hello", "Great", "BAD", "good!", "(bad)", "ok?", "--"]
    made = [rng.choice([" ", "  ", "\n"]).join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(300)]
    return FIXED + made


@pytest.mark.parametrize("entries", [100, 2])
def test_scores(spark, texts, entries):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    got = {r["id"]: r["compound"] for r in score_texts(df, "text", lexicon, scheme=SCHEME, broadcast_entries=entries).collect()}
    assert got == {i: pytest.approx(by_hand(t), abs=1e-4) for i, t in enumerate(texts)}


def test_copies_of_a_text_score_the_same(spark):
    df = spark.createDataFrame([(i % 3, "very good, not bad!") for i in range(900)], "id long, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    out = add_sentiment(df, "text", lexicon, scheme=SCHEME)
    assert out.count() == 900
    assert {(r["vader_compound"], r["vader_sentiment"]) for r in out.collect()} == {(by_hand("very good, not bad!"), "positive")}


def test_repeated_and_missing_ids_score_row_by_row(spark, texts):
    rows = [(None if i % 4 == 0 else i % 3, t) for i, t in enumerate(texts[:60])]
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    for entries in (100, 2):
        out = score_texts(spark.createDataFrame(rows, "id long, text string"), "text", lexicon, scheme=SCHEME, broadcast_entries=entries)
        got = sorted((str(r["id"]), str(r["text"]), r["compound"]) for r in out.collect())
        expected = sorted((str(i), str(t), round(by_hand(t), 4)) for i, t in rows)
        assert [r[:2] for r in got] == [r[:2] for r in expected]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in expected], abs=1e-4)


def stepwise(text, lexicon=LEXICON, scheme=PUBLISHED):
    """The published steps, word by word."""
    words = []
    for raw in (text or "").split():
        bare = raw.strip(string.punctuation)
        words.append(bare if len(bare) > 2 else raw)
    low = [w.lower() for w in words]
    upper = [w == w.upper() and w != w.lower() for w in words]
    mixed = any(upper) and not all(upper)
    turn = min((i for i, w in enumerate(low) if w in scheme.contrast), default=None)

    def negated(word):
        return word in scheme.negators or "n't" in word

    total = 0
    for i, word in enumerate(low):
        if word not in lexicon or word in scheme.boosters or low[i : i + 2] == ["kind", "of"]:
            continue
        value, b = lexicon[word], {d: low[i - d] for d in (1, 2, 3) if i >= d}
        if word == "no" and i + 1 < len(low) and low[i + 1] in lexicon:
            value = 0.0
        if b.get(1) == "no" or b.get(2) == "no" or (b.get(3) == "no" and b[1] in ("or", "nor")):
            value = lexicon[word] * -0.74
        if upper[i] and mixed:
            value += 0.733 if value > 0 else -0.733
        for d, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if d not in b or b[d] in lexicon:
                continue
            degree = scheme.boosters.get(b[d], 0.0)
            if degree:
                degree = -degree if value < 0 else degree
                if upper[i - d] and mixed:
                    degree += 0.733 if value > 0 else -0.733
            value += degree * damping
            if d == 2 and b[2] == "never" and b[1] in ("so", "this"):
                value *= 1.25
            elif d == 3 and ((b[3] == "never" and b[2] in ("so", "this")) or b[1] in ("so", "this")):
                value *= 1.25
            elif b[d] == "without" and "doubt" in [b[e] for e in range(1, d)]:
                pass
            elif negated(b[d]):
                value *= -0.74
            if d == 3:
                say = lambda first, last: " ".join(low[i + first : i + last + 1])
                for place in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)):
                    if say(*place) in scheme.phrases.idioms:
                        value = scheme.phrases.idioms[say(*place)]
                        break
                for last in (1, 2):
                    if i + last < len(low) and say(0, last) in scheme.phrases.idioms:
                        value = scheme.phrases.idioms[say(0, last)]
                for place in ((-3, -1), (-3, -2), (-2, -1)):
                    value += scheme.boosters.get(say(*place), 0.0)
        if b.get(1) == "least" and "least" not in lexicon and b.get(2) not in ("at", "very"):
            value *= -0.74
        if turn is not None and i != turn:
            value *= 0.5 if i < turn else 1.5
        total += math.floor(value * 1e9 + 0.5)
    x = total / 1e9
    if x:
        asks = (text or "").count("?")
        extra = min((text or "").count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0)
        x += math.copysign(extra, x)
    return round(x / math.sqrt(x * x + 15), 4)


MORE = LEXICON | {"no": -1.2, "kind": 2.4, "broken": -2.1, "heart": 2.0, "die": -2.9, "shit": -2.6, "death": -2.9, "never": -0.5}


@pytest.mark.parametrize("lexicon", [LEXICON, MORE], ids=["few", "more"])
@pytest.mark.parametrize("entries", [100, 2])
def test_phrases_go_through_the_published_steps(spark, texts, lexicon, entries):
    rng = random.Random(8)
    pool = [
        *lexicon, "kind", "of", "sort", "just", "enough", "never", "so", "this", "without", "doubt", "least", "at", "VERY", "no", "nor", "or",
        "really", "EXTREMELY", "doesn't", "mustn't", "broken", "heart", "to", "die", "for", "the", "shit", "kiss", "of", "death", "it", "and", "but",
    ]
    made = [" ".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(700)]
    every = [*texts, *made]
    df = spark.createDataFrame(list(enumerate(every)), "id long, text string").repartition(5)
    table = spark.createDataFrame(list(lexicon.items()), "token string, valence double")
    got = {r["id"]: r["compound"] for r in score_texts(df, "text", table, broadcast_entries=entries).collect()}
    assert got == {i: pytest.approx(stepwise(t, lexicon), abs=1e-4) for i, t in enumerate(every)}


@pytest.mark.parametrize("plain,changed", [
    ("it was all good", "it was kind of good"), ("it was all good", "it was just enough good"), ("we do not doubt good", "we go without doubt good"),
    ("it was ever so good", "it was never so good"), ("it was some good", "it was least good"), ("it was least good", "it was at least good"),
    ("he has a broken arm and a good one", "he has a broken heart and a good one"),
])
def test_phrases_change_scores(spark, plain, changed):
    table = spark.createDataFrame(list((LEXICON | {"broken": -2.1}).items()), "token string, valence double")
    df = spark.createDataFrame([(plain,), (changed,)], "text string")
    a, b = (r["compound"] for r in score_texts(df, "text", table).collect())
    assert a != b


P, N = "ketosis", "stalled"


@pytest.mark.parametrize("label", ["positive", "neutral", "negative"])
@pytest.mark.parametrize("text", [f"{P.upper()} {N}", P, N, "nothing", ""])
def test_rules_flip(spark, label, text):
    positive, negative = P in text.lower(), N in text
    expected = label
    if positive and label != "positive":
        expected = "positive"
    elif negative and label != "negative":
        expected = "negative"
    df = spark.createDataFrame([(text, label, "keto")], "t string, l string, topic string")
    assert df.select(corrected_label(F.col("t"), F.col("l"), F.col("topic"))).first()[0] == expected


def test_rules_by_topic(spark):
    rows = [
        ("healthy", None, None, "positive"), ("healthy", "neutral", "keto", "neutral"), ("healthy", "neutral", "other", "positive"),
        ("all my nsv today", "negative", "keto", "positive"), ("hard fasting", "neutral", "intermittentfasting", "negative"),
        ("fasting", "neutral", "intermittentfasting", "neutral"), (None, "positive", "keto", "positive"),
        ("iron is low", "positive", "plantbaseddiet", "negative"),
    ]
    df = spark.createDataFrame(rows, "t string, l string, topic string, expected string")
    out = df.select(corrected_label(F.col("t"), F.col("l"), F.col("topic")).alias("got"), "expected").collect()
    assert [r["got"] for r in out] == [r["expected"] for r in out]


def test_rule_table_size():
    sizes = {t: (len(r["positive"]), len(r["negative"])) for t, r in DOMAIN_RULES.items()}
    assert sizes == {"keto": (19, 12), "intermittentfasting": (15, 12), "plantbaseddiet": (18, 16), "general": (6, 6)}


@pytest.mark.parametrize("entries", [100, 2])
def test_the_published_steps_are_compiled(spark, capsys, entries):
    """The JVM leaves methods of more than 8,000 bytes uncompiled."""
    df = spark.createDataFrame([(1, "not good")], "id long, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        score_texts(df, "text", lexicon, scheme=PUBLISHED, broadcast_entries=entries).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
