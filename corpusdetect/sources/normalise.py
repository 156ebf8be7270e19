"""Bring raw rows (XML attributes, old files) into the fixed schemas, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.languages import canonical_language
from ..schemas import DETECTION_SCHEMA, SAMPLE_SCHEMA

# Written in place of a missing value where everything is text.
NONE_TEXT = "None"


def _text(df: DataFrame, name: str) -> Column:
    """The column as text; absent columns and the missing-value text are null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.col(name).cast("string"), F.lit(NONE_TEXT))


def _raw(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _seconds(text: Column) -> Column:
    """Whole seconds; fractions round half to even."""
    rounded = F.bround(text.try_cast("double"), 0).cast("bigint")
    return F.coalesce(text.try_cast("bigint"), rounded)


def normalise_samples(df: DataFrame) -> DataFrame:
    """Sample rows in the fixed schema, languages in canonical spelling."""
    plain = {n: _raw(df, n) for n in ("Generator", "Code", "Prompt", "OriginalPrompt", "Dataset")}
    columns = plain | {
        "Language": canonical_language(_raw(df, "Language")),
        "TopK": _text(df, "TopK").try_cast("int"),
        "TopP": _text(df, "TopP").try_cast("double"),
        "Temperature": _text(df, "Temperature").try_cast("double"),
        "Date": _seconds(_raw(df, "Date")),
    }
    return df.select(*[columns[f.name].alias(f.name) for f in SAMPLE_SCHEMA])


def normalise_detections(df: DataFrame) -> DataFrame:
    """Detection rows in the fixed schema; a score written ``[x]`` reads as x."""
    value = _raw(df, "Value")
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    plain = "PromptHash CodeSampleHash Detector Generator BaseModel Code Dataset".split()
    columns = {n: _raw(df, n) for n in plain} | {
        "Language": _text(df, "Language"),
        "Value": F.coalesce(value.try_cast("double"), inner.try_cast("double")),
        "MaxLength": _text(df, "MaxLength").try_cast("int"),
        "SecondaryModel": _text(df, "SecondaryModel"),
        "TopK": _text(df, "TopK").try_cast("int"),
        "TopP": _text(df, "TopP").try_cast("double"),
        "Temperature": _text(df, "Temperature").try_cast("double"),
        "Date": _seconds(_raw(df, "Date")),
    }
    return df.select(*[columns[f.name].alias(f.name) for f in DETECTION_SCHEMA])


def as_record(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed record of a stored table, in column order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def as_text_record(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Record of strings: missing values spelled out, missing code empty."""
    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("" if name == "Code" else NONE_TEXT))

    return df.select(*[spelled(f.name).alias(f.name) for f in schema])
