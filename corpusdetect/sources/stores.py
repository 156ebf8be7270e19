"""Parquet and XML stores of samples and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import COMPACT, setting
from ..schemas import DETECTION_SCHEMA, SAMPLE_SCHEMA, as_text
from .normalise import as_record, as_text_record, normalise_detections, normalise_samples

KINDS = {
    "sample": (SAMPLE_SCHEMA, normalise_samples),
    "detection": (DETECTION_SCHEMA, normalise_detections),
}

# Rows per file, as in existing stores.
PARQUET_ROWS_PER_FILE = 100_000
XML_ROWS_PER_FILE = 5_000
# Finds copies of a text within a page, where Spark's usual one looks back 64 KB only.
PARQUET_COMPRESSION = COMPACT
# Detections repeat a text for each model. A row group keeps a text once, in a dictionary of so many bytes, and ends
# before most texts fill it, so that the better but slower level compresses few bytes.
DETECTION_OPTIONS = {
    "parquet.dictionary.page.size": 8 << 20,
    "parquet.block.row.count.limit": 10_000,
    "parquet.compression.codec.zstd.level": 6,
}
# Slices that a task writes at once; the rows of further ones are sorted first.
OPEN_SLICES = 16

_XML = {"rowTag": "sample", "attributePrefix": "", "ignoreSurroundingSpaces": "false"}
_CORRUPT = "_corrupt"

# Characters that the XML 1.0 standard does not allow or discourages; plane by plane the two
# noncharacters of the Unicode standard at its end.
_BASIC = r"\x00-\x08\x0B-\x1F\x7F-\x84\x86-\x9F\uD800-\uDFFF\uFDD0-\uFDDF\uFFFE-\uFFFF"
_PLANES = "".join(f"\\x{{{plane:X}FFFE}}-\\x{{{plane:X}FFFF}}" for plane in range(1, 17))
# Nearly all characters are told from these by the first two ranges.
ILLEGAL_XML = f"[[^\\x20-\\x7E\\xA0-\\uD7FF]&&[{_BASIC}{_PLANES}]]"
_KEPT_WHEN_ESCAPED = ILLEGAL_XML.replace(r"\x0B-\x1F", r"\x0B\x0C\x0E-\x1F")
# Lines without any doubt: one fast pass, listed characters being a look into a table.
_COMMON_ONLY = r"\A[" + "".join(f"\\x{c:02X}" for c in range(0x20, 0x7F)) + r"\xA0-\uD7FF]*+\z"
# No XML parser takes these in an attribute.
_FATAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def read_parquet(spark: SparkSession, path: str, kind: str = "sample", legacy: bool = False) -> DataFrame:
    """A Parquet store in its fixed schema.

    ``legacy`` reads files whose inferred columns differ (all-null columns,
    fractional dates, missing columns) and normalises them. Otherwise columns
    and filters reach the scan untouched; only the second model, which old
    writers spelled ``None``, is corrected.
    """
    schema, normalise = KINDS[kind]
    if legacy:
        return normalise(spark.read.option("mergeSchema", True).parquet(path))
    df = spark.read.schema(schema).parquet(path)
    if kind == "detection":
        df = df.withColumn("SecondaryModel", F.nullif(F.col("SecondaryModel"), F.lit("None")))
    return df


def write_parquet(df: DataFrame, path: str, kind: str = "sample", partition_by: tuple[str, ...] = ()) -> None:
    """Append to a Parquet store, optionally laid out by slice columns.

    Rows are written in the order they come in, a file per slice open at a time, so that whole texts are not sorted by
    slice, and copies of a text that follow one another take next to no room.
    """
    writer = as_record(df, KINDS[kind][0]).write.mode("append").option("compression", PARQUET_COMPRESSION)
    if kind == "detection":
        writer = writer.options(**DETECTION_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_SLICES)):
        writer.option("maxRecordsPerFile", PARQUET_ROWS_PER_FILE).parquet(path)


def read_xml(spark: SparkSession, path: str, kind: str = "sample", on_broken: str = "error") -> DataFrame:
    """An XML store: one ``<sample …/>`` element with attributes per row.

    An element that does not parse is repaired and parsed again. One that stays broken fails the
    read, or is left out with ``on_broken="drop"`` (:func:`broken_elements` lists those).
    """
    schema, normalise = KINDS[kind]
    rows = _elements(spark, path, schema)
    if on_broken == "drop":
        rows = rows.filter(f"row.{_CORRUPT} is null")
    elif on_broken == "error":
        message = F.concat(F.lit("broken element: "), F.substring(f"row.{_CORRUPT}", 1, 200))
        failed = F.raise_error(message).cast(rows.schema["row"].dataType)
        rows = rows.withColumn("row", F.when(F.col(f"row.{_CORRUPT}").isNull(), F.col("row")).otherwise(failed))
    else:
        raise ValueError(f"unknown choice {on_broken!r}")
    return normalise(rows.select("row.*").drop(_CORRUPT))


def broken_elements(spark: SparkSession, path: str, kind: str = "sample") -> DataFrame:
    """``(value)``: the elements of a store that do not parse even after repair."""
    rows = _elements(spark, path, KINDS[kind][0])
    return rows.filter(f"row.{_CORRUPT} is not null").select(F.col(f"row.{_CORRUPT}").alias("value"))


def _elements(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(row)``: each element, repaired where it has to be; what is still broken has _CORRUPT set.

    Stores hold an element per line, so files are split anywhere and a broken element cannot end the
    reading of those behind it, as it does in a parser of whole documents.
    """
    return _parsed(spark.read.text(path), schema, "value").select("row")


def write_xml(df: DataFrame, path: str, kind: str = "sample", compression: str = "none") -> None:
    """Append to an XML store; characters XML cannot hold become spaces.

    Files are small enough to be read as wholes, so they may be compressed (``gzip``); readers know by their names.
    """
    record = as_text_record(df, KINDS[kind][0])
    safe = [F.regexp_replace(c, _KEPT_WHEN_ESCAPED, " ").alias(f"_{c}") for c in record.columns]
    (
        record.select(*safe)
        .write.mode("append")
        .format("xml")
        .option("rootTag", "samples")
        .option("rowTag", "sample")
        .option("maxRecordsPerFile", XML_ROWS_PER_FILE)
        .option("compression", compression)
        .save(path)
    )


def repair_line(line: Column) -> Column:
    """A store line without illegal characters and with straight quotes."""
    legal = F.regexp_replace(line, ILLEGAL_XML, " ")
    return F.replace(F.replace(legal, F.lit("\u201c"), F.lit('"')), F.lit("\u201d"), F.lit('"'))


def parse_lines(lines: DataFrame, kind: str = "sample", column: str = "value") -> DataFrame:
    """Rows of store lines; a line that does not parse is repaired and read again.

    Lines without a sample element are skipped, and lines that stay broken are
    a second output, :func:`broken_lines`.
    """
    schema, normalise = KINDS[kind]
    return normalise(_parsed(lines, schema, column).filter(f"row.{_CORRUPT} is null").select("row.*"))


def broken_lines(lines: DataFrame, kind: str = "sample", column: str = "value") -> DataFrame:
    """The sample lines that do not parse even after repair."""
    parsed = _parsed(lines, KINDS[kind][0], column)
    return parsed.filter(f"row.{_CORRUPT} is not null").select(column)


# What character references in attributes stand for, the ampersand last. Others go to the parser.
_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#xA": "\n", "#xa": "\n", "#10": "\n", "#xD": "\r",
               "#xd": "\r", "#13": "\r", "#x9": "\t", "#9": "\t", "amp": "&"}


def _decoded(value: Column) -> Column:
    """A value whose references are all known, in one pass: behind an ampersand stand a name, a semicolon and text."""
    signs = F.create_map(*[F.lit(x) for pair in _REFERENCES.items() for x in pair])
    pieces = F.split(value, "&", -1)
    rest = F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda x: F.concat(F.try_element_at(signs, F.substring_index(x, ";", 1)), F.substr(x, F.instr(x, ";") + 1)),
    )
    return F.when(F.contains(value, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(value)


def _known_references(line: Column) -> Column:
    """Whether behind each ampersand stand a known name and a semicolon."""
    pieces = F.split(line, "&", -1)
    names = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.forall(names, lambda x: F.contains(x, F.lit(";")) & F.substring_index(x, ";", 1).isin(*_REFERENCES))


def _taken_apart(lines: DataFrame, line: str, clean: str, names: list[str]) -> DataFrame:
    """Adds ``_plain``, whether a line is plainly one element with quoted attributes, and the struct ``_attributes`` of these.

    Between quotes stand, in turn, names and values, so one split takes the element apart. Anything out of
    the ordinary (other quotes, references or tags, characters that XML does not allow) is not plain. Lines that are
    ``clean`` have no such characters. What several expressions look at is a column, so that it is made once.
    """
    trimmed = F.trim(F.col(line))
    parts, tags, values = F.col("_parts"), F.col("_tags"), F.col("_values")
    heads = F.filter(parts, lambda _, i: i % 2 == 0)
    heads = F.slice(heads, F.lit(1), F.size(heads) - 1)
    heads = F.transform(heads, lambda x, i: F.when(i == 0, F.regexp_replace(x, "^<sample(?= )", "")).otherwise(x))
    plain = (
        (F.size(parts) % 2 == 1)
        & (F.size(parts) > 1)
        & F.element_at(parts, -1).rlike("^ ?/>$")
        & F.forall(tags, lambda x: x.rlike("^ [A-Za-z_][A-Za-z0-9_]*=$"))
        & (F.size(F.array_distinct(tags)) == F.size(tags))
        & ~F.contains(F.substring(trimmed, 2, 2147483647), F.lit("<"))
        & ~F.contains(F.col(line), F.lit("\t"))
        & (F.col(clean) | ~F.col(line).rlike(ILLEGAL_XML))
        & _known_references(F.col(line))
    )
    found = [
        _decoded(F.get(values, (F.array_position(tags, f" {n}=") - 1).cast("int"))).alias(n) for n in names
    ]
    return (
        lines.withColumn("_parts", F.split(trimmed, '"', -1))
        .withColumns({"_tags": heads, "_values": F.filter(parts, lambda _, i: i % 2 == 1)})
        .withColumn("_plain", F.coalesce(plain, F.lit(False)))
        .withColumn("_attributes", F.when(F.col("_plain"), F.struct(*found, F.lit(None).cast("string").alias(_CORRUPT))))
        .drop("_parts", "_tags", "_values")
    )


def _parsed(lines: DataFrame, schema: T.StructType, column: str) -> DataFrame:
    """Adds ``row``: the attributes by expressions where the line is plain, else by the XML parser.

    A character between quotes that no parser takes is repaired before, as the line would not parse.
    """
    wide = T.StructType([*as_text(schema).fields, T.StructField(_CORRUPT, T.StringType())])
    options = {**_XML, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    line = F.col(column)
    outer = [F.substring_index(line, '"', i) for i in (1, -1)]
    broken = line.rlike(_FATAL) & ~outer[0].rlike(_FATAL) & ~outer[1].rlike(_FATAL)
    tried = lines.filter(line.contains("<sample ")).withColumn("_clean", line.rlike(_COMMON_ONLY))
    tried = tried.withColumn("_line", F.when(F.col("_clean") | ~broken, line).otherwise(repair_line(line)))
    tried = _taken_apart(tried, "_line", "_clean", [f.name for f in as_text(schema)])
    first = F.from_xml(line, _ddl(wide), options)
    second = F.from_xml(repair_line(line), _ddl(wide), options)
    parsed = tried.withColumn("_row", F.when(F.col("_plain"), F.col("_attributes")).otherwise(first))
    row = F.when(F.col(f"_row.{_CORRUPT}").isNull(), F.col("_row")).otherwise(second)
    # A generator, so that a filter on the row is not pushed below and all of this made again for it.
    return parsed.select(*lines.columns, F.explode(F.array(row)).alias("row"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} string" for f in schema)


def read_xml_repaired(spark: SparkSession, path: str, kind: str = "sample") -> DataFrame:
    """An XML store with broken characters, read line by line."""
    return parse_lines(spark.read.text(path), kind)


def read_store(spark: SparkSession, path: str, form: str, kind: str = "sample") -> DataFrame:
    return {"parquet": read_parquet, "xml": read_xml}[form](spark, path, kind)


def convert(
    spark: SparkSession, path: str, form: str, target: str, kind: str = "sample", compression: str = "gzip"
) -> None:
    """Copy a store into the other format: read, normalise, write.

    XML is compressed, as it spells out each copy of a text that a sample holds; ``none`` writes plain files.
    """
    if form == "xml":
        write_parquet(read_xml(spark, path, kind), target, kind)
    else:
        write_xml(read_parquet(spark, path, kind), target, kind, compression)
