"""Foreign JSON array files of any size, read by many tasks.

An export is one array, often on a single line, so lines can't split it. It is
read with the closing brace as the end of a line instead: Spark cuts the file
into byte ranges and every row is what lies between two closing braces. What a
row means depends on what came before: whether it starts inside a string, and how
deep. A first pass finds for each range how it changes both, once for a start
inside and once outside a string; folded in file order, that gives every range
its start. An array may go on over the part files of one write. The second pass cuts the records, the objects at depth one. A record
that crosses into other ranges leaves a piece in each; only these are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Strings (open ones too, the group is the closing quote) and brackets; the rest of a string that was open before.
TOKENS = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.DOTALL)
REST_OF_STRING = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL)


@dataclass
class Place:
    """Where reading stands: in a string or not, and below how many brackets; the least depth is kept."""

    in_string: bool
    depth: int = 0
    least: int = 0

    def brackets(self, row: bytes) -> Iterator[tuple[int, bool]]:
        """Reads a row with its closing brace; yields (place in the row, opening) for each bracket after counting it."""
        at = 0
        if self.in_string:
            rest = REST_OF_STRING.match(row)
            at, self.in_string = rest.end(), not rest[1]
        for token in TOKENS.finditer(row, at):
            first = row[token.start()]
            if first == 0x22:
                self.in_string = not token[1]
                continue
            opening = first in b"{["
            self.depth += 1 if opening else -1
            self.least = min(self.least, self.depth)
            yield token.start(), opening

    def read(self, row: bytes) -> None:
        for _ in self.brackets(row):
            pass


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of the range, row) with the closing brace that ended the row."""
    for batch in batches:
        for path, start, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            yield path, start, row + b"}"


CHANGES = "path string, start long, string_after_text boolean, depth_after_text int, least_after_text int, string_after_string boolean, depth_after_string int, least_after_string int"


def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: what it does to a start outside and inside a string."""
    own, found = None, []

    def close() -> None:
        if own:
            found.append((*own, *[x for p in (outside, inside) for x in (p.in_string, p.depth, p.least)]))

    for path, start, row in ranges(batches):
        if own != (path, start):
            close()
            own, outside, inside = (path, start), Place(False), Place(True)
        outside.read(row)
        inside.read(row)
    close()
    names = [c.split()[0] for c in CHANGES.split(", ")]
    yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], pa.schema([(n, KINDS[c.split()[1]]) for n, c in zip(names, CHANGES.split(", "))]))


KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


# A part file of one write, up to the number of the part and behind it.
PART_FILE = re.compile(r"(.*/part-)\d+(-[0-9a-f-]{36}).*")


def continues(path: str, before: str | None) -> bool:
    """Whether both are part files of one write, so that an array may go on from one to the next."""
    mine, theirs = PART_FILE.match(path), PART_FILE.match(before or "")
    return bool(mine and theirs and mine.groups() == theirs.groups())


def starts(summaries: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each range whether it starts in a string, at what depth, and the range in which the open record began."""
    found, path, in_string, depth = {}, None, False, 0
    for s in sorted(summaries, key=lambda s: (s["path"], s["start"])):
        if s["path"] != path:
            # Part files end with a line's end, which was read with a brace that isn't there.
            depth = max(depth + 1, 0) if not in_string and continues(s["path"], path) else 0
            path, in_string, begun = s["path"], False, -1
        found[path, s["start"]] = (in_string, depth, begun)
        side = "string" if in_string else "text"
        closed = depth + s[f"least_after_{side}"] <= 1
        depth, in_string = depth + s[f"depth_after_{side}"], s[f"string_after_{side}"]
        if depth >= 2 and (closed or begun < 0):
            begun = s["start"]
        elif depth < 2:
            begun = -1
    return found


# Bytes of records after which a batch is handed on.
BATCH_BYTES = 4_000_000
PIECES = "path string, begun long, start long, whole boolean, piece string"


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of every object of the arrays in the files; elements of other kinds are left out.

    The driver keeps a few numbers for each range of ``spark.sql.files.maxPartitionBytes``
    (at 128 MB some 100 bytes, 1 MB for a terabyte). A compressed file is one range.
    """
    rows = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("row")
    )
    known = spark.sparkContext.broadcast(starts(rows.mapInArrow(changes, CHANGES).collect()))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, held, begun, found, is_record = None, None, [], -1, [], False

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [KINDS[c.split()[1]] for c in PIECES.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def close(whole: bool) -> None:
            if held:
                found.append((own[0], begun, own[1], whole, b"".join(held).decode("utf-8", "replace")))
                held.clear()

        size = 0
        for path, start, row in ranges(batches):
            if own != (path, start):
                close(False)
                own = (path, start)
                in_string, depth, begun = known.value[own]
                place, is_record = Place(in_string, depth), depth >= 2
            # From here on the row belongs to the open record.
            record_from = 0 if is_record else None
            for at, opening in place.brackets(row):
                if opening and place.depth == 2:
                    is_record, begun = row[at] == 0x7B, start
                    record_from = at if is_record else None
                elif not opening and place.depth == 1 and record_from is not None:
                    held.append(row[record_from : at + 1])
                    size += at + 1 - record_from
                    close(begun == start)
                    record_from, is_record = None, False
            if record_from is not None:
                held.append(row[record_from:])
            if size > BATCH_BYTES:
                yield batch()
                size = 0
        close(False)
        yield batch()

    pieces = rows.mapInArrow(tasks, PIECES)
    crossing = pieces.where(~F.col("whole")).groupBy("path", "begun").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    # What began as another kind of element has no piece with its start.
    joined = crossing.select(F.array_join(F.col("pieces.piece"), "").alias("record")).where(F.startswith("record", F.lit("{")))
    return pieces.where("whole").select(F.col("piece").alias("record")).unionByName(joined)
