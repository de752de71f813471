"""Text normalizers: they differ on purpose, and views name the one they use."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every character that Unicode calls white space.
UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]+"


def normalized_phrase(text: Column, fold_sharp_s: bool = True) -> Column:
    """Drops the literal pause mark and all white space, then folds case."""
    out = F.lower(F.regexp_replace(F.replace(text, F.lit("<p>"), F.lit("")), UNICODE_SPACE, ""))
    return F.replace(out, F.lit("ß"), F.lit("ss")) if fold_sharp_s else out


@F.pandas_udf(T.StringType())
def compatibility_phrase(texts: pd.Series) -> pd.Series:
    """Compatibility normalization, flexible pause mark, white space and full case folding."""
    composed = texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
    bare = composed.str.replace(r"(?i)<\s*p\s*>", "", regex=True).str.replace(r"\s+", "", regex=True)
    return bare.map(lambda t: None if t is None else t.casefold())


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed != "", trimmed)


def first_present(*fields: Column) -> Column:
    """The first field that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(f) for f in fields])


def first_present_or_meta(row_fields: list[str], meta: str, keys: tuple[str, ...]) -> Column:
    """The first field of the row that is present, else the first present key of its nested map."""
    return first_present(*[F.col(f) for f in row_fields], *[F.try_element_at(F.col(meta), F.lit(k)) for k in keys])


@F.pandas_udf(T.ArrayType(T.StringType()))
def flattened_keys(texts: pd.Series) -> pd.Series:
    """Dotted paths of all keys of a JSON object, nested ones and those of objects in lists included, sorted; none for other text."""

    def paths(text: str | None) -> list[str]:
        try:
            left = [("", json.loads(text))]
        except (TypeError, ValueError, RecursionError):
            return []
        found = set()
        while left:
            prefix, value = left.pop()
            if isinstance(value, dict):
                found |= {f"{prefix}{k}" for k in value}
                left += [(f"{prefix}{k}.", v) for k, v in value.items()]
            elif isinstance(value, list):
                left += [(prefix, v) for v in value]
        return sorted(found)

    return texts.map(paths)


def dataset_of(dataset: Column, utt_id: Column) -> Column:
    """The dataset field, or what stands before the colon of a qualified id."""
    qualified = F.when(utt_id.contains(":"), F.substring_index(utt_id, ":", 1))
    return F.coalesce(blank_to_null(dataset), blank_to_null(qualified))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")


def label_line(line: Column) -> Column:
    """A label line split once at white space: the key's stem and the rest."""
    pattern = r"^\s*(\S+)\s+(.*?)\s*$"
    return F.struct(file_stem(F.regexp_extract(line, pattern, 1)).alias("key"), F.regexp_extract(line, pattern, 2).alias("text"))


def delimiter_of(line: Column) -> Column:
    """Name of the first delimiter that a line contains."""
    out = F.lit("none")
    for name, sign in reversed((("tab", "\t"), ("pipe", "|"), ("comma", ","), ("semicolon", ";"), ("space", " "))):
        out = F.when(line.contains(sign), name).otherwise(out)
    return out


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(100 * share, digits), F.lit("%"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
