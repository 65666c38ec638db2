"""Text and time expressions on posts and comments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Bodies a moderator or author took away.
REMOVED_BODIES = ("[deleted]", "[removed]")

# White space as a Unicode-aware strip() sees it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often it is used.

    Inside a lambda function an outer expression would run for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip_space(col: Column) -> Column:
    """Take all white space off both ends; plain trim() takes blanks only."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return F.length(strip_space(null_text(col))) == 0


def drop_prefix3(col: Column) -> Column:
    """Text from the fourth character on, whatever the first three are."""
    return F.substring(col, 4, 2147483647)


def drop_post_prefix(col: Column) -> Column:
    """Remove every ``t3_`` of an id that starts with it; leave other ids."""
    return F.when(F.startswith(col, F.lit("t3_")), F.replace(col, F.lit("t3_"), F.lit(""))).otherwise(col)


def epoch_to_timestamp(col: Column) -> Column:
    """Epoch seconds as text or number, with fractions, to a UTC timestamp.

    TIMESTAMP_NTZ keeps the result free of the session time zone. Text that is
    no number gives null.
    """
    micros = F.round(F.try_multiply(col.try_cast("double"), F.lit(1e6))).try_cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def clean_escapes(col: Column) -> Column:
    """Replace literal backslash-u escapes (``\\u00e9``) by a blank."""
    return F.regexp_replace(col, r"\\u[0-9A-Fa-f]{4}", " ")


def is_kept_body(col: Column) -> Column:
    """A body that has text and was not deleted or removed."""
    return ~is_blank(col) & ~null_text(col).isin(*REMOVED_BODIES)


def combined_text(title: Column, selftext: Column, body: Column) -> Column:
    """Title, post text and comment text with blanks between; gaps left out."""
    parts = F.concat_ws(
        " ",
        F.when(~is_blank(title), title),
        F.when(is_kept_body(selftext), selftext),
        F.when(is_kept_body(body), body),
    )
    return strip_space(parts)


def record_kind(title: Column) -> Column:
    return F.when(F.length(title) > 0, "submission").otherwise("comment")


def thread_text(title: Column, selftext: Column, children: Column) -> Column:
    """Title over text, an empty line, then the joined children.

    A post without children keeps the trailing empty line; a null title or
    text leaves only the children.
    """
    head = F.concat(title, F.lit("\n"), selftext)
    return F.concat_ws("\n\n", head, null_text(children))


def thread_text_inline(title: Column, selftext: Column, children: Column) -> Column:
    """One line; null as soon as title or text is null."""
    return F.concat(title, F.lit(" "), selftext, F.lit(" "), null_text(children))


def label_task_text(title: Column, selftext: Column, children: list[Column]) -> Column:
    """Stripped title, text and numbered comments; absent parts left out."""

    def present(col: Column) -> Column:
        return F.length(col) > 0

    parts = [F.when(present(c), strip_space(c)) for c in (title, selftext)]
    parts += [
        F.when(present(c), F.concat(F.lit(f"-- Comment {i} --\n"), strip_space(c)))
        for i, c in enumerate(children, start=1)
    ]
    return F.concat_ws("\n\n", *parts)


def preview(col: Column, width: int = 100) -> Column:
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width)), F.lit("..."))).otherwise(col)


def words(col: Column, pattern: str = r"[\p{L}\p{N}_]{2,}") -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))


def in_list(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows of the given categories; all rows if none are given."""
    return df.where(F.col(column).isin(*values)) if values else df
