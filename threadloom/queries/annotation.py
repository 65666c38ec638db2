"""Labels in nested annotation records, made from the label table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import annotations as an
from threadloom.functions.labels import canonical_label
from threadloom.operators.sampling import capped
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.session import scratch_path
from threadloom.sinks.tables import write_json_array, write_json_arrays, write_json_lines
from threadloom.sources import tasks

# Seven shapes a record can have, by document number:
# 0 no annotations; 1 empty result, then the label; 2 another field, then the
# label; 3 plain label; 4 empty choices, then the label; 5 wrong type; 6 two
# annotations, the first with an unknown label. Label texts: as stored, and
# "off-topic" for documents in Spanish.
SHAPES = 7
LABEL = f"CASE WHEN lang = 'es' THEN 'off-topic' ELSE sentiment END"


def annotation_rows(spark, sf):
    """Labelled documents as annotation records."""
    word = F.when(F.col("lang") == "es", F.lit("off-topic")).otherwise(F.col("sentiment"))

    def choice(value, name="sentiment", kind="choices"):
        return F.struct(F.lit(name).alias("from_name"), F.lit(kind).alias("type"), F.struct(value.alias("choices")).alias("value"))

    good = choice(F.array(word))
    none = F.array().cast("array<string>")

    def annotation(*results):
        rows = F.array(*results) if results else F.slice(F.array(good), 1, 0)
        return F.struct(rows.alias("result"))

    shape = F.col("doc_id") % SHAPES
    shapes = {
        0: F.slice(F.array(annotation(good)), 1, 0),
        1: F.array(annotation(), annotation(good)),
        2: F.array(annotation(choice(F.array(F.lit("vegan")), "diet"), good)),
        3: F.array(annotation(good)),
        4: F.array(annotation(choice(none), good)),
        5: F.array(annotation(choice(F.array(word), kind="labels"))),
        6: F.array(annotation(choice(F.array(F.lit("unsure"), word))), annotation(good)),
    }
    built = None
    for number, value in shapes.items():
        built = F.when(shape == number, value) if built is None else built.when(shape == number, value)
    return st.labelled(spark, sf, st.table(spark, sf, "documents")).select(
        F.concat(F.lit("t"), F.col("doc_id")).alias("id"), F.struct("text", "source").alias("data"), built.alias("annotations"),
        F.lit("2024-01-01").alias("created_at"),
    )


def annotated(spark, sf, array_file=False):
    """The records, written and read as JSON lines or as files of one array each."""
    path = scratch_path(spark, "tasks")
    (write_json_arrays if array_file else write_json_lines)(annotation_rows(spark, sf), path)
    return tasks.annotated_tasks(spark, path, array_file)


def one_array(spark, sf):
    """The records as a labelling tool exports them: one array in one file."""
    path = scratch_path(spark, "export")
    write_json_array(annotation_rows(spark, sf), path)
    return tasks.annotated_tasks(spark, path, array_file=True)


@query("src_annotated_tasks", f"""WITH {st.LABELLED}
SELECT 't' || doc_id AS id, text, CASE doc_id % {SHAPES} WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS n_annotations FROM labelled""")
def src_annotated_tasks(spark, sf):
    return annotated(spark, sf, array_file=True).select("id", F.col("data.text").alias("text"), F.size("annotations").alias("n_annotations"))


@query("labels_extract_strict", f"""WITH {st.LABELLED}
SELECT 't' || doc_id AS id, CASE WHEN doc_id % {SHAPES} IN (2, 3) THEN {LABEL} WHEN doc_id % {SHAPES} = 6 THEN 'unsure' END AS label FROM labelled""")
def labels_extract_strict(spark, sf):
    return annotated(spark, sf).select("id", an.strict_label(F.col("annotations")).alias("label"))


@query("labels_extract_first", f"""WITH {st.LABELLED}
SELECT 't' || doc_id AS id, CASE doc_id % {SHAPES} WHEN 0 THEN NULL WHEN 6 THEN 'unsure'
       ELSE CASE WHEN lang = 'es' THEN 'offtopic' ELSE sentiment END END AS label FROM labelled""")
def labels_extract_first(spark, sf):
    return annotated(spark, sf).select("id", canonical_label(an.first_label(F.col("annotations"))).alias("label"))


# Whole records are kept: also the keys that no label function reads.
@query("labels_valid_any", f"""WITH {st.LABELLED}
SELECT 't' || doc_id AS id, text, source, '2024-01-01' AS created_at FROM labelled WHERE doc_id % {SHAPES} <> 0""")
def labels_valid_any(spark, sf):
    kept = annotated(spark, sf).where(an.has_valid_label(F.col("annotations")))
    path = scratch_path(spark, "kept-tasks")
    tasks.write_records(kept, path)
    return spark.read.schema("id string, data struct<text: string, source: string>, created_at string").json(path).select(
        "id", "data.*", "created_at"
    )


@query("labels_invalid_audit", f"""WITH {st.LABELLED}
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % {SHAPES} IN (2, 3) THEN {LABEL} WHEN doc_id % {SHAPES} = 6 THEN 'unsure' END AS label FROM labelled)
WHERE label IS NULL OR label NOT IN ('negative', 'neutral', 'positive') GROUP BY label""")
def labels_invalid_audit(spark, sf):
    labels = annotated(spark, sf).select(an.strict_label(F.col("annotations")).alias("label"))
    return an.invalid_labels(labels, "label")


RECORDS = f"""{st.LABELLED}, records AS (SELECT 't' || doc_id AS id, text, source, '2024-01-01' AS created_at, doc_id,
  CASE doc_id % {SHAPES} WHEN 0 THEN NULL WHEN 6 THEN 'unsure' ELSE CASE WHEN lang = 'es' THEN 'offtopic' ELSE sentiment END END AS label
  FROM labelled)"""
RECORD_SCHEMA = "id string, data struct<text: string, source: string>, created_at string"


def _parsed(records):
    """The columns of whole records, also of keys that no label function reads."""
    return records.select(F.from_json("record", RECORD_SCHEMA).alias("r")).select("r.id", "r.data.*", "r.created_at")


@query("sink_json_array", f"WITH {RECORDS} SELECT id, text, source, created_at FROM records")
def sink_json_array(spark, sf):
    return _parsed(one_array(spark, sf))


# From the tool's export to a balanced one: whole records with a valid label, at most 70 positive and 100 neutral ones.
@query("labelling_loop", f"""WITH {RECORDS}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rk FROM records)
SELECT id, text, source, created_at FROM placed
WHERE label IN ('negative', 'offtopic') OR (label = 'positive' AND rk <= 70) OR (label = 'neutral' AND rk <= 100)""")
def labelling_loop(spark, sf):
    exported = one_array(spark, sf)
    kept = exported.where(an.has_valid_label(F.col("annotations"))).withColumn("label", canonical_label(an.first_label(F.col("annotations"))))
    number = F.substring("id", 2, 20).cast("long")
    balanced = capped(kept, "label", {"positive": 70, "neutral": 100}, ["negative", "offtopic"], [number])
    path = scratch_path(spark, "balanced")
    tasks.write_record_array(balanced, path)
    return _parsed(tasks.annotated_tasks(spark, path, array_file=True))
