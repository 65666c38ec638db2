"""Lexicon sentiment, rules, and the two whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.hashing import hash_bucket
from threadloom.functions.labels import by_threshold, lookup, topic_of
from threadloom.functions.text import combined_text, drop_prefix3, record_kind
from threadloom.operators import rules as ru
from threadloom.operators.sampling import balanced
from threadloom.operators.sentiment import Phrases, Scheme, add_sentiment, score_texts
from threadloom.operators.threads import attach_children, best_first, inline_thread_texts
from threadloom.plans.balance import balance, balance_dumps
from threadloom.plans.thread_export import export_threads, load_dumps
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.queries.sources import EPOCH_SQL, GROUP, document_dumps, write_dumps
from threadloom.session import scratch_path, settle
from threadloom.sinks.tables import write_parquet

SCHEME = Scheme(boosters=st.BOOSTERS, negators=st.NEGATORS, contrast=st.CONTRAST, phrases=None)


def _num(x: float) -> str:
    return f"{x!r}e0"


def _words(items) -> str:
    return ", ".join(f"'{w}'" for w in items)


def sentiment_ctes(rel: str, ident: str, text: str, name: str) -> str:
    """CTEs ending in ``name`` (sid, compound): the scoring scheme word by word."""
    p = f"{name}_"
    boost = ", ".join(
        f"('{w}', {', '.join(_num(v * d) for d in SCHEME.damping)})" for w, v in SCHEME.boosters.items()
    )
    flips = " + ".join(f"CASE WHEN b{d} IN ({_words(SCHEME.negators)}) THEN 1 ELSE 0 END" for d in (1, 2, 3))
    factors = " ".join(f"WHEN {n} THEN {_num(SCHEME.negation**n)}" for n in (1, 2, 3))
    return rf"""{p}lists AS (
  SELECT {ident} AS sid, coalesce({text}, '') AS body,
         list_filter(string_split_regex(coalesce({text}, ''), '[ \t\n\r\f\v]+'), lambda t: length(t) > 0) AS raws FROM {rel}),
{p}raws AS (SELECT sid, unnest(raws) AS raw, unnest(range(0, len(raws))) AS i FROM {p}lists),
{p}toks AS (SELECT sid, i, CASE WHEN length(bare) > 2 THEN bare ELSE raw END AS tok FROM (
  SELECT *, regexp_replace(raw, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g') AS bare FROM {p}raws)),
{p}flags AS (SELECT sid, i, tok, lower(tok) AS low, tok = upper(tok) AND tok <> lower(tok) AS caps FROM {p}toks),
{p}facts AS (SELECT sid, bool_or(NOT caps) AS mixed, min(i) FILTER (low IN ({_words(SCHEME.contrast)})) AS turn FROM {p}flags GROUP BY sid),
{p}ctx AS (SELECT sid, i, low, caps, lag(low, 1) OVER w AS b1, lag(low, 2) OVER w AS b2, lag(low, 3) OVER w AS b3
  FROM {p}flags WINDOW w AS (PARTITION BY sid ORDER BY i)),
{p}boost AS (SELECT * FROM (VALUES {boost}) AS v(token, d1, d2, d3) WHERE token NOT IN (SELECT token FROM lexicon)),
{p}parts AS (
  SELECT c.sid, floor((l.valence + sign(l.valence) * coalesce(x1.d1, 0) + sign(l.valence) * coalesce(x2.d2, 0)
      + sign(l.valence) * coalesce(x3.d3, 0) + sign(l.valence) * CASE WHEN c.caps AND f.mixed THEN {_num(SCHEME.capitals)} ELSE 0 END)
    * CASE {flips} {factors} ELSE 1.0e0 END
    * CASE WHEN c.i < f.turn THEN 0.5e0 WHEN c.i > f.turn THEN 1.5e0 ELSE 1.0e0 END * 1e9 + 0.5)::BIGINT AS units
  FROM {p}ctx c JOIN lexicon l ON c.low = l.token JOIN {p}facts f ON c.sid = f.sid
    LEFT JOIN {p}boost x1 ON c.b1 = x1.token LEFT JOIN {p}boost x2 ON c.b2 = x2.token LEFT JOIN {p}boost x3 ON c.b3 = x3.token),
{p}sums AS (SELECT sid, sum(units)::DOUBLE / 1e9 AS total FROM {p}parts GROUP BY sid),
{p}marks AS (
  SELECT b.sid, coalesce(s.total, 0) AS total, least(length(b.body) - length(replace(b.body, '!', '')), 4) * 0.292e0 AS loud,
         length(b.body) - length(replace(b.body, '?', '')) AS asks FROM {p}lists b LEFT JOIN {p}sums s ON b.sid = s.sid),
{p}loud AS (SELECT sid, total + sign(total) * (loud + CASE WHEN asks > 3 THEN 0.96e0 WHEN asks > 1 THEN asks * 0.18e0 ELSE 0 END) AS x FROM {p}marks),
{name} AS (SELECT sid, round(x / sqrt(x * x + 15.0e0), 4) AS compound FROM {p}loud)"""


def class_sql(score: str, high: float, low: float) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'positive' WHEN {score} <= {low} THEN 'negative' ELSE 'neutral' END"


DOC_SCORES = f"{st.LEXICON}, {sentiment_ctes('documents', 'doc_id', 'text', 'scores')}"


@query("sentiment_lexicon", f"WITH {DOC_SCORES} SELECT sid AS doc_id, compound FROM scores")
def sentiment_lexicon(spark, sf):
    docs = st.documents(spark, sf).select("doc_id", "text")
    return score_texts(docs, "text", st.lexicon(spark, sf), scheme=SCHEME).drop("text")


@query("sentiment_lexicon_join", f"WITH {DOC_SCORES} SELECT sid AS doc_id, compound FROM scores")
def sentiment_lexicon_join(spark, sf):
    docs = st.documents(spark, sf).select("doc_id", "text")
    scored = score_texts(docs, "text", st.lexicon(spark, sf), scheme=SCHEME, broadcast_entries=0)
    return scored.drop("text")


# Every document three times under one id: each row has the score of its own text.
@query("sentiment_lexicon_copies", f"WITH {DOC_SCORES} SELECT sid % 7 AS id, compound FROM scores CROSS JOIN range(3)")
def sentiment_lexicon_copies(spark, sf):
    docs = st.documents(spark, sf).select((F.col("doc_id") % 7).alias("id"), "text", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return score_texts(docs, "text", st.lexicon(spark, sf), scheme=SCHEME).select("id", "compound")


@query("sentiment_class", f"WITH {DOC_SCORES} SELECT sid AS doc_id, compound AS vader_compound, {class_sql('compound', 0.05, -0.05)} AS vader_sentiment FROM scores")
def sentiment_class(spark, sf):
    docs = st.documents(spark, sf).select("doc_id", "text")
    return add_sentiment(docs, "text", st.lexicon(spark, sf), scheme=SCHEME).drop("text")


# Function words of the invented prose in the roles of the phrases.
PHRASED = Scheme(
    boosters=st.BOOSTERS | {"of the": 0.293, "and of the": 0.293, "to the": -0.293}, negators=st.NEGATORS, contrast=st.CONTRAST,
    phrases=Phrases(
        idioms={"in the": 2.5, "la de": -1.5, "a of": 0.0, "the the the": 1.0, "to of to": -3.0}, never="that", so=("to", "it"), without="in",
        doubt="a", least="for", spared=("was", "on"), no="en", alternatives=("le", "die"), unvalued=("by", "this"), contraction="rre",
    ),
)


def phrase_ctes(rel: str, ident: str, text: str, name: str) -> str:
    """CTEs ending in ``name`` (sid, compound): the published steps, with the words around each word in columns."""
    p, rules = f"{name}_", PHRASED.phrases
    single = {w: v for w, v in PHRASED.boosters.items() if " " not in w}
    several = {w: v for w, v in PHRASED.boosters.items() if " " in w}

    def lookup_sql(key: str, table, default: str) -> str:
        cases = " ".join(f"WHEN '{w}' THEN {_num(v)}" for w, v in table.items())
        return f"CASE {key} {cases} ELSE {default} END"

    def step(d: int) -> str:
        degree, c = lookup_sql(f"b{d}", single, "0.0e0"), f"c{d} AND mixed"
        so = f"b{d} = '{rules.never}' AND b{d - 1} IN ({_words(rules.so)})"
        so = {1: "false", 2: so, 3: f"({so}) OR b1 IN ({_words(rules.so)})"}[d]
        doubt = " OR ".join([f"b{e} = '{rules.doubt}'" for e in range(1, d)]) or "false"
        loud = f"CASE WHEN {c} THEN CASE WHEN v > 0 THEN {_num(PHRASED.capitals)} ELSE {_num(-PHRASED.capitals)} END ELSE 0.0e0 END"
        return f"""{p}raised{d} AS (SELECT *, v + CASE WHEN degree <> 0
    THEN (CASE WHEN v < 0 THEN -degree ELSE degree END + {loud}) * {_num(PHRASED.damping[d - 1])} ELSE 0.0e0 END AS r
  FROM (SELECT *, {degree} AS degree FROM {p}step{d - 1})),
{p}step{d} AS (SELECT * EXCLUDE (v, r, degree), CASE WHEN b{d} IS NULL OR k{d} THEN v WHEN {so} THEN r * {_num(rules.strengthened)}
    WHEN b{d} = '{rules.without}' AND ({doubt}) THEN r
    WHEN b{d} IN ({_words(PHRASED.negators)}) OR contains(b{d}, '{rules.contraction}') THEN r * {_num(PHRASED.negation)} ELSE r END AS v
  FROM {p}raised{d})"""

    def idiom(key: str, default: str) -> str:
        return f"coalesce({lookup_sql(key, rules.idioms, 'NULL')}, {default})"

    # From the last looked at to the first.
    value = "v"
    for key in ("b3 || ' ' || b2", "b3 || ' ' || b2 || ' ' || b1", "b2 || ' ' || b1", "b2 || ' ' || b1 || ' ' || low", "b1 || ' ' || low",
                "low || ' ' || a1", "low || ' ' || a1 || ' ' || a2"):
        value = idiom(key, value)
    for key in ("b3 || ' ' || b2 || ' ' || b1", "b3 || ' ' || b2", "b2 || ' ' || b1"):
        value = f"({value}) + {lookup_sql(key, several, '0.0e0')}"
    around = ", ".join(f"lag(low, {d}) OVER w AS b{d}, lag(caps, {d}) OVER w AS c{d}, coalesce(lag(known, {d}) OVER w, false) AS k{d}" for d in (1, 2, 3))
    plain = sentiment_ctes(rel, ident, text, name)
    head, tail = plain.split(f"{p}ctx AS")[0], plain[plain.index(f"{p}sums AS") :]
    no = f"b1 = '{rules.no}' OR b2 = '{rules.no}' OR (b3 = '{rules.no}' AND b1 IN ({_words(rules.alternatives)}))"
    return rf"""{head}{p}ctx AS (SELECT sid, i, low, caps, valence, {around}, lead(low, 1) OVER w AS a1, lead(low, 2) OVER w AS a2,
    coalesce(lead(known, 1) OVER w, false) AS ka
  FROM (SELECT f.*, l.valence, l.token IS NOT NULL AS known FROM {p}flags f LEFT JOIN lexicon l ON f.low = l.token)
  WINDOW w AS (PARTITION BY sid ORDER BY i)),
{p}hits AS (SELECT c.*, f.mixed, f.turn, CASE WHEN {no} THEN valence * {_num(PHRASED.negation)}
    WHEN low = '{rules.no}' AND ka THEN 0.0e0 ELSE valence END AS v0
  FROM {p}ctx c JOIN {p}facts f ON c.sid = f.sid WHERE valence IS NOT NULL),
{p}step0 AS (SELECT * EXCLUDE (v0), v0 + CASE WHEN caps AND mixed THEN CASE WHEN v0 > 0 THEN {_num(PHRASED.capitals)}
    ELSE {_num(-PHRASED.capitals)} END ELSE 0.0e0 END AS v FROM {p}hits),
{step(1)},
{step(2)},
{step(3)},
{p}said AS (SELECT * EXCLUDE (v), CASE WHEN b3 IS NULL OR k3 THEN v ELSE {value} END AS v FROM {p}step3),
{p}least AS (SELECT * EXCLUDE (v), CASE WHEN low IN ({_words(PHRASED.boosters)}) OR (low = '{rules.unvalued[0]}' AND coalesce(a1 = '{rules.unvalued[1]}', false)) THEN 0.0e0
    WHEN b1 = '{rules.least}' AND NOT k1 AND coalesce(b2 NOT IN ({_words(rules.spared)}), true) THEN v * {_num(PHRASED.negation)} ELSE v END AS v FROM {p}said),
{p}parts AS (SELECT sid, floor(v * CASE WHEN i < turn THEN 0.5e0 WHEN i > turn THEN 1.5e0 ELSE 1.0e0 END * 1e9 + 0.5)::BIGINT AS units FROM {p}least),
{tail}"""


@query("sentiment_phrases", f"WITH {st.LEXICON}, {phrase_ctes('documents', 'doc_id', 'text', 'scores')} SELECT sid AS doc_id, compound FROM scores")
def sentiment_phrases(spark, sf):
    docs = st.documents(spark, sf).select("doc_id", "text")
    return score_texts(docs, "text", st.lexicon(spark, sf), scheme=PHRASED).drop("text")


# Rules that match the invented prose, added to the domain rules.
EXTRA_RULES: ru.Rules = {
    "keto": {"positive": [("the", "andan"), ("ouin",)], "negative": [("der", "und", "tei"), ("la", "eré")]},
    "intermittentfasting": {"positive": [("tion", "hereb")], "negative": [("ndo", "ell")]},
    "plantbaseddiet": {"positive": [("aux", "pour")], "negative": [("erer", "th"), ("nan", "on", "zz")]},
    "general": {"positive": [("ingre",), ("ment", "que")], "negative": [("und", "sch")]},
}
RULES: ru.Rules = {
    topic: {side: [*lists[side], *EXTRA_RULES[topic][side]] for side in ("positive", "negative")}
    for topic, lists in ru.DOMAIN_RULES.items()
}


def rules_sql(text: str, topic: str, side: str) -> str:
    def any_of(rules) -> str:
        terms = [" AND ".join("contains(%s, '%s')" % (text, t.replace("'", "''")) for t in rule) for rule in rules]
        return "(" + " OR ".join(f"({t})" for t in terms) + ")"

    cases = " ".join(f"WHEN '{name}' THEN {any_of(lists[side])}" for name, lists in RULES.items() if name != ru.FALLBACK)
    return f"CASE {topic} {cases} ELSE {any_of(RULES[ru.FALLBACK][side])} END"


def corrected_sql(text: str, label: str, topic: str) -> str:
    return f"""CASE WHEN length({text}) = 0 THEN {label}
  WHEN {label} <> 'positive' AND {rules_sql(f'lower({text})', topic, 'positive')} THEN 'positive'
  WHEN {label} <> 'negative' AND {rules_sql(f'lower({text})', topic, 'negative')} THEN 'negative' ELSE {label} END"""


RULED = f"""ruled AS (SELECT doc_id, topic, old, {corrected_sql('text', 'old', 'topic')} AS sentiment FROM (
  SELECT doc_id, text, {st.TOPIC} AS topic, CASE {st.bucket_sql('doc_id::VARCHAR', 3)} WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS old
  FROM (SELECT doc_id, text, {st.SUBREDDIT} AS subreddit FROM documents)))"""


def _ruled(spark, sf):
    label = lookup(hash_bucket("doc_id", buckets=3), {0: "positive", 1: "negative", 2: "neutral"})
    docs = st.documents(spark, sf).select(
        "doc_id", "text", label.alias("sentiment"), topic_of(st.subreddit(F.col("source"))).alias("topic")
    )
    return ru.correct(docs, "text", rules=RULES, keep_old="old")


@query("rules_correct", f"WITH {RULED} SELECT doc_id, topic, old, sentiment FROM ruled")
def rules_correct(spark, sf):
    return _ruled(spark, sf).select("doc_id", "topic", "old", "sentiment")


@query("rules_change_count", f"WITH {RULED} SELECT count(*) AS objects, count(*) FILTER (old <> sentiment) AS corrections FROM ruled")
def rules_change_count(spark, sf):
    return ru.change_counts(_ruled(spark, sf), "old", "sentiment")


# Every language of the labelled documents is balanced on its own.
@query("sample_balanced_groups", f"""WITH {st.LABELLED}, placed AS (
  SELECT doc_id, lang, sentiment, row_number() OVER (PARTITION BY lang, sentiment ORDER BY {st.key_sql('doc_id::VARCHAR')}) AS rk FROM labelled),
sizes AS (SELECT lang, min(n) AS n FROM (SELECT lang, sentiment, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY lang HAVING count(*) = 3)
SELECT doc_id, lang, sentiment FROM placed JOIN sizes USING (lang) WHERE rk <= least(25, n)""")
def sample_balanced_groups(spark, sf):
    rows = st.labelled(spark, sf).select("doc_id", "lang", "sentiment")
    return balanced(rows, "sentiment", ["doc_id"], 25, by=["lang"]).select("doc_id", "lang", "sentiment")


def objects_sql(target: int | None, grouped: bool) -> str:
    """CTEs ending in ``objects``: scored posts, all or balanced, and their best comments, over all posts or per data set group."""
    group = GROUP if grouped else "'all'"
    turn_group = "CASE WHEN length(id) % 2 = 0 THEN 'keto' ELSE 'paleo' END" if grouped else "'all'"
    rank = "" if target is None else f"WHERE rk <= least({target}, s.n)"
    return f"""WITH {st.LEXICON}, {st.RAW_DOCUMENTS}, {st.RAW_TURNS},
texts AS (SELECT * FROM (
  SELECT id, subreddit, score, created_utc, {st.TOPIC} AS topic, {group} AS grp,
         CASE WHEN length(title) > 0 THEN 'submission' ELSE 'comment' END AS post_type,
         regexp_replace(concat_ws(' ', title, CASE WHEN regexp_matches(selftext, '\\S') AND selftext NOT IN ('[deleted]', '[removed]') THEN selftext END),
           '^\\s+|\\s+$', '', 'g') AS text_content FROM raw_documents) WHERE length(text_content) > 0),
{sentiment_ctes('texts', 'id', 'text_content', 'post_scores')},
scored AS (SELECT t.*, {class_sql('compound', 0.5, -0.5)} AS sentiment FROM texts t JOIN post_scores ON id = sid),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp, sentiment ORDER BY {st.key_sql('id')}) AS rk FROM scored),
sizes AS (SELECT grp, min(n) AS n FROM (SELECT grp, sentiment, count(*) AS n FROM scored GROUP BY ALL) GROUP BY grp HAVING count(*) = 3),
sample AS (SELECT p.* FROM placed p {'LEFT' if target is None else ''} JOIN sizes s ON p.grp = s.grp {rank}),
turns AS (SELECT *, {turn_group} AS grp FROM raw_turns),
kept AS (SELECT *, row_number() OVER (PARTITION BY grp, link_id ORDER BY score DESC, id) AS rn FROM turns
  WHERE regexp_matches(coalesce(body, ''), '\\S') AND body NOT IN ('[deleted]', '[removed]')
    AND EXISTS (SELECT 1 FROM sample WHERE 't3_' || sample.id = link_id AND sample.grp = turns.grp)),
top AS (SELECT * FROM kept WHERE rn <= 2),
{sentiment_ctes('top', 'id', 'body', 'turn_scores')},
objects AS (
  SELECT grp, text_content, sentiment, subreddit, topic, score, created_utc, id, post_type, NULL::VARCHAR AS parent_id FROM sample
  UNION ALL
  SELECT grp, body, {class_sql('compound', 0.5, -0.5)}, subreddit, 'keto', score, created_utc, id, 'comment', substr(link_id, 4)
  FROM top JOIN turn_scores ON id = sid)"""


def balance_sql(target: int, grouped: bool) -> str:
    """The balance job word by word."""
    shown = "grp AS dataset_group, " if grouped else ""
    return f"""{objects_sql(target, grouped)}
SELECT {shown}text_content, subreddit, topic, score, created_utc, id, post_type, parent_id,
       {corrected_sql('text_content', 'sentiment', 'topic')} AS sentiment FROM objects"""


# All posts with their own texts and scores, and their two best comments, scored alike.
@query("thread_attach_scored", f"""{objects_sql(None, False)}
SELECT text_content, sentiment, subreddit, topic, score, created_utc, id, post_type, parent_id FROM objects""")
def thread_attach_scored(spark, sf):
    words = settle(st.lexicon(spark, sf), "lexicon")
    text = combined_text(F.col("title"), F.col("selftext"), F.col("body"))
    usable = st.raw_documents(spark, sf).withColumn("text_content", text).where(F.length("text_content") > 0)
    scored = score_texts(usable, "text_content", words, "_compound", SCHEME)
    sample = settle(
        scored.select(
            "text_content", by_threshold(F.col("_compound"), 0.5, -0.5).alias("sentiment"), "subreddit",
            topic_of(F.col("subreddit")).alias("topic"), "score", "created_utc", "id", record_kind(F.col("title")).alias("post_type"),
        ),
        "sample",
    )
    score = lambda df, column, out: score_texts(df, column, words, out, SCHEME)
    return attach_children(sample, st.raw_turns(spark, sf), score, 2, best_first("id"))


@query("balance_job", balance_sql(100, grouped=False))
def balance_job(spark, sf):
    words = settle(st.lexicon(spark, sf), "lexicon")
    return balance(
        st.raw_documents(spark, sf), words, st.raw_turns(spark, sf), target=100, k=2,
        comment_order=best_first("id"), rules=RULES, scheme=SCHEME,
    )


@query("balance_dumps_job", balance_sql(20, grouped=True))
def balance_dumps_job(spark, sf):
    out = scratch_path(spark, "balanced")
    balance_dumps(
        spark, document_dumps(spark, sf), out, settle(st.lexicon(spark, sf), "lexicon"), target=20,
        comment_order=best_first("id"), rules=RULES, scheme=SCHEME,
    )
    columns = "text_content string, subreddit string, topic string, score long, created_utc string, id string, post_type string, "
    return spark.read.schema(columns + "parent_id string, sentiment string, dataset_group string").json(out)


# Texts of a view, scored in a second view, written with a folder per split.
@query("scored_threads_by_split", f"""WITH {st.LEXICON}, {st.RAW_DOCUMENTS}, {st.RAW_TURNS},
ranked AS (SELECT substr(link_id, 4) AS post_id, body, row_number() OVER (PARTITION BY link_id ORDER BY score DESC, id) AS rn FROM raw_turns),
children AS (SELECT post_id, string_agg(body, ' ' ORDER BY rn) AS children FROM ranked WHERE rn <= 3 GROUP BY post_id),
thread_view AS (SELECT p.id, p.subreddit AS category, p.title || ' ' || p.selftext || ' ' || coalesce(c.children, '') AS text, p.score,
  p.created_utc AS created_ts, {st.split_sql('p.id')} AS split
  FROM raw_documents p LEFT JOIN children c ON p.id = c.post_id WHERE p.selftext IS NOT NULL),
{sentiment_ctes('thread_view', 'id', 'text', 'scores')}
SELECT t.*, compound AS vader, {class_sql('compound', 0.05, -0.05)} AS vader_label FROM thread_view t JOIN scores ON id = sid""")
def scored_threads_by_split(spark, sf):
    posts = st.raw_documents(spark, sf).withColumnsRenamed({"subreddit": "category", "created_utc": "created_ts"}).drop("body")
    turns = st.raw_turns(spark, sf).withColumn("post_id", drop_prefix3(F.col("link_id")))
    inline_thread_texts(posts, turns, 3, best_first("id")).createOrReplaceTempView("thread_view")
    scored = add_sentiment(spark.table("thread_view"), "text", st.lexicon(spark, sf), scheme=SCHEME)
    scored.withColumnsRenamed({"vader_compound": "vader", "vader_sentiment": "vader_label"}).createOrReplaceTempView("scored_view")
    path = scratch_path(spark, "scored_view")
    write_parquet(spark.table("scored_view"), path, ["split"])
    return spark.read.parquet(path)


@query("thread_export_job", f"""WITH {st.POSTS}, {st.COMMENTS},
stored AS (SELECT DISTINCT id, post_id, coalesce(body, '') AS body, floor(score)::BIGINT AS score,
  {EPOCH_SQL.format('post_id::BIGINT')} AS created_ts FROM comments WHERE parent_id LIKE 't3_%'),
once AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS copy FROM stored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, created_ts, id) AS rn FROM once WHERE copy = 1),
children AS (SELECT post_id, string_agg(body, chr(10) || chr(10) ORDER BY rn) AS children FROM ranked WHERE rn <= 3 GROUP BY post_id)
SELECT p.id, p.subreddit AS category, concat_ws(chr(10) || chr(10),
         coalesce(p.title, '') || chr(10) || coalesce(p.selftext, ''), coalesce(c.children, '')) AS text
FROM posts p LEFT JOIN children c ON p.id = c.post_id WHERE floor(p.score)::BIGINT > 1""")
def thread_export_job(spark, sf):
    posts, comments = load_dumps(spark, write_dumps(spark, sf), scratch_path(spark, "store"))
    return export_threads(posts, comments, scratch_path(spark, "train"), k=3, min_score=1)
