"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from guichet import vocabulary as V

# Unicode white space and the four ASCII separators, other than the blank.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def quoted(name: str) -> Column:
    """A column by its literal name, whatever dots or apostrophes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def map_columns(df: DataFrame, names: Iterable[str], change) -> DataFrame:
    """Replace each listed column by ``change(column)`` in a single projection."""
    chosen = set(names)
    return df.select(
        *[
            change(quoted(c)).alias(c) if c in chosen else quoted(c)
            for c in df.columns
        ]
    )


def missing_to_null(c: Column, tokens=tuple(V.MISSING_TOKENS)) -> Column:
    return F.when(~c.isin(*tokens), c)


def _plain_blanks(c: Column) -> Column:
    """Straight apostrophes, every white space a blank, none at the ends."""
    return F.trim(F.translate(c, "’" + _SPACES, "'" + " " * len(_SPACES)))


def _single_blanks(c: Column) -> Column:
    return F.when(c.contains("  "), F.regexp_replace(c, "  +", " ")).otherwise(c)


def _known(c: Column) -> Column:
    return F.nullif(c, F.lit("nan"))


def normalize_text(c: Column) -> Column:
    """Straight apostrophes, no outer white space, single inner blanks; ``nan`` is null."""
    return _known(_single_blanks(_plain_blanks(c)))


def normalize_texts(df: DataFrame) -> DataFrame:
    """``normalize_text`` on every text column, one projection per step: each step uses
    its input more than once, and so it is computed only once."""
    names = text_columns(df)
    for step in (_plain_blanks, _single_blanks, _known):
        df = map_columns(df, names, step)
    return df


def merge_labels(df: DataFrame, merges: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Unify spellings by exact match; columns the table lacks are skipped."""
    for name, pairs in merges.items():
        if name in df.columns and pairs:
            df = map_columns(df, [name], lambda c, pairs=pairs: _relabel(c, pairs))
    return df


def _relabel(c: Column, pairs: Mapping[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.element_at(lookup, c), c)


def capitalize(c: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def financing_class(
    c: Column,
    grant: str = V.GRANT_LABEL,
    loan: str = V.LOAN_LABEL,
) -> Column:
    return (
        F.when(c == grant, V.GRANT_CLASS)
        .when(c == loan, V.LOAN_CLASS)
        .otherwise(V.OTHER_CLASS)
    )


def short_value(c: Column, width: int = 40) -> Column:
    """A quoted value, cut to ``width`` characters with an ellipsis."""
    text = c.cast("string")
    cut = F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    ).otherwise(text)
    escaped = cut
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = F.lit("'"), F.lit('"')
    return (
        F.when(~cut.contains("'"), F.concat(single, escaped, single))
        .when(~cut.contains('"'), F.concat(double, escaped, double))
        .otherwise(F.concat(single, F.replace(escaped, single, F.lit("\\'")), single))
    )
