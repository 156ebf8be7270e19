"""Readers, writers, converters and source projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st
from ..plans.storage import parts_for, scratch_path
from ..schemas import DETECTION_SCHEMA, SAMPLE_SCHEMA
from ..sources import normalise, problems, stores
from ..sources.catalog import Catalog
from ..sources.connector import PositionedSource, register, stream_source
from ..streaming import ingest
from .detection_queries import RUN_TIME
from .registry import query
from .sample_queries import _FENCED, _FENCE, DATE_SQL, fenced
from .views import CORPORA, SPELLINGS, canonical_sql, detections, pick, samples, sql, table

_SAMPLE_COLUMNS = ", ".join(SAMPLE_SCHEMA.names)
_SAMPLE_ROWS = sql("samples", select=f"SELECT {_SAMPLE_COLUMNS} FROM samples")


# --------------------------------------------------------------- normalisers

_RAW_SAMPLES = """SELECT sample_id, Generator, Language, Code, CASE WHEN sample_id % 3 = 0 THEN 'None' WHEN sample_id % 3 = 1 THEN '50' END AS TopK,
    coalesce(TopP::VARCHAR, 'None') AS TopP, coalesce(Temperature::VARCHAR, 'None') AS Temperature, Prompt, OriginalPrompt,
    Date || CASE sample_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.0' WHEN 2 THEN '.5' ELSE '.75' END AS Date, Dataset FROM raw_samples"""


def _raw_samples(spark, folder):
    """Rows as old text stores hold them."""
    n = F.col("sample_id")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return (
        samples(spark, folder, raw_language=True)
        .withColumn("TopK", F.when(n % 3 == 0, "None").when(n % 3 == 1, "50"))
        .withColumn("TopP", shown("TopP"))
        .withColumn("Temperature", shown("Temperature"))
        .withColumn("Date", F.concat(F.col("Date").cast("string"), pick(("", ".0", ".5", ".75"), n % 4)))
    )


@query("normalise_sample", sql("raw_samples", ("raw", _RAW_SAMPLES), select=f"""SELECT Generator, {canonical_sql('Language')} AS Language, Code,
    TRY_CAST(nullif(TopK, 'None') AS INTEGER) AS TopK, TRY_CAST(nullif(TopP, 'None') AS DOUBLE) AS TopP,
    TRY_CAST(nullif(Temperature, 'None') AS DOUBLE) AS Temperature, Prompt, OriginalPrompt,
    CAST(round_even(Date::DOUBLE, 0) AS BIGINT) AS Date, Dataset FROM raw"""))
def normalise_sample(spark, folder):
    return normalise.normalise_samples(_raw_samples(spark, folder))


_RAW_DETECTIONS = """SELECT sha256(sample_id::VARCHAR) AS PromptHash, sha256('x' || sample_id) AS CodeSampleHash, Language,
    CASE WHEN sample_id % 2 = 0 THEN '[' || sample_id || '.25]' ELSE sample_id || '.5' END AS Value, CASE WHEN sample_id % 3 = 0 THEN '512' ELSE 'None' END AS MaxLength,
    Detector, Generator, BaseModel, coalesce(SecondaryModel, 'None') AS SecondaryModel, coalesce(TopP::VARCHAR, 'None') AS TopP, Dataset FROM detections"""


@query("normalise_detection", sql("samples", "detections", ("raw", _RAW_DETECTIONS), select=f"""SELECT PromptHash, CodeSampleHash, Language,
    CAST(trim(Value, '[]') AS DOUBLE) AS Value, TRY_CAST(MaxLength AS INTEGER) AS MaxLength, Detector, Generator, BaseModel,
    nullif(SecondaryModel, 'None') AS SecondaryModel, CAST(NULL AS VARCHAR) AS Code, CAST(NULL AS INTEGER) AS TopK, TRY_CAST(TopP AS DOUBLE) AS TopP,
    CAST(NULL AS DOUBLE) AS Temperature, CAST({RUN_TIME} AS BIGINT) AS Date, Dataset FROM raw"""))
def normalise_detection(spark, folder):
    """Old detection rows: bracketed scores, missing columns, spelled-out nulls."""
    n = F.col("sample_id")
    number = n.cast("string")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    raw = detections(spark, folder).select(
        F.sha2(number, 256).alias("PromptHash"),
        F.sha2(F.concat(F.lit("x"), number), 256).alias("CodeSampleHash"),
        "Language",
        F.when(n % 2 == 0, F.concat(F.lit("["), number, F.lit(".25]"))).otherwise(F.concat(number, F.lit(".5"))).alias("Value"),
        F.when(n % 3 == 0, "512").otherwise("None").alias("MaxLength"),
        "Detector", "Generator", "BaseModel",
        shown("SecondaryModel").alias("SecondaryModel"),
        shown("TopP").alias("TopP"),
        F.lit(str(RUN_TIME)).alias("Date"),
        "Dataset",
    )
    return normalise.normalise_detections(raw)


@query("text_record", sql("samples", select="""SELECT Generator, Language, coalesce(Code, '') AS Code, 'None' AS TopK, coalesce(TopP::VARCHAR, 'None') AS TopP,
    coalesce(Temperature::VARCHAR, 'None') AS Temperature, Prompt, OriginalPrompt, Date::VARCHAR AS Date, Dataset FROM samples"""))
def text_record(spark, folder):
    return normalise.as_text_record(samples(spark, folder), SAMPLE_SCHEMA)


# -------------------------------------------------------------------- stores


@query("parquet_round_trip", _SAMPLE_ROWS)
def parquet_round_trip(spark, folder):
    path = scratch_path(spark, "samples")
    stores.write_parquet(samples(spark, folder), path, partition_by=("Dataset",))
    return stores.read_parquet(spark, path)


@query("parquet_legacy", _SAMPLE_ROWS)
def parquet_legacy(spark, folder):
    """Two files whose columns differ, as writers without a fixed schema leave them."""
    path = scratch_path(spark, "legacy")
    rows = samples(spark, folder).drop("sample_id")
    human = rows.filter("Generator = 'human'").drop("TopK", "TopP", "Temperature")
    human.write.parquet(f"{path}/a")
    rows.filter("Generator <> 'human'").write.parquet(f"{path}/b")
    return stores.read_parquet(spark, f"{path}/*", legacy=True)


@query("xml_round_trip", _SAMPLE_ROWS)
def xml_round_trip(spark, folder):
    path = scratch_path(spark, "xml")
    stores.write_xml(samples(spark, folder), path)
    return stores.read_xml(spark, path)


@query("convert_format", _SAMPLE_ROWS)
def convert_format(spark, folder):
    """Parquet to XML and back."""
    first, second, third = (scratch_path(spark, x) for x in ("parquet", "xml", "parquet"))
    stores.write_parquet(samples(spark, folder), first)
    stores.convert(spark, first, "parquet", second)
    stores.convert(spark, second, "xml", third)
    return stores.read_parquet(spark, third)


_DETECTION_ROWS = f"""SELECT NULL::VARCHAR AS PromptHash, sha256(sample_id::VARCHAR) AS CodeSampleHash, Language,
    CASE WHEN Value IS NULL OR isnan(Value) OR isinf(Value) THEN NULL ELSE Value END AS Value, CAST(NULL AS INTEGER) AS MaxLength, Detector, Generator,
    BaseModel, SecondaryModel, '' AS Code, CAST(NULL AS INTEGER) AS TopK, TopP, Temperature, CAST({RUN_TIME} AS BIGINT) AS Date, Dataset FROM detections"""


@query("detection_store", sql("samples", "detections", select=_DETECTION_ROWS.replace("NULL::VARCHAR AS PromptHash", "'None' AS PromptHash")))
def detection_store(spark, folder):
    """Detection rows through the XML store; missing hashes are spelled out there."""
    v = F.col("Value")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    rows = detections(spark, folder).select(
        F.lit(None).cast("string").alias("PromptHash"), F.sha2(F.col("sample_id").cast("string"), 256).alias("CodeSampleHash"),
        "Language", finite.alias("Value"), F.lit(None).cast("int").alias("MaxLength"), "Detector", "Generator", "BaseModel",
        "SecondaryModel", F.lit(None).cast("string").alias("Code"), F.lit(None).cast("int").alias("TopK"), "TopP", "Temperature",
        F.lit(RUN_TIME).cast("bigint").alias("Date"), "Dataset",
    )
    path = scratch_path(spark, "detections")
    stores.write_xml(rows, path, "detection")
    return stores.read_xml(spark, path, "detection").select(*DETECTION_SCHEMA.names)


@query("xml_repair", """SELECT doc_id::VARCHAR AS Prompt, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END || text AS Code FROM documents""")
def xml_repair(spark, folder):
    """Store lines, every third with a control character that XML forbids."""
    escaped = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("\x01")).otherwise(F.lit(""))
    lines = table(spark, folder, "documents").select(
        F.concat(F.lit('  <sample Prompt="'), F.col("doc_id").cast("string"), F.lit('" Code="'), mark, escaped, F.lit('" />')).alias("value")
    )
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    return stores.read_xml_repaired(spark, path).select("Prompt", "Code")


@query("catalog_stores", sql("samples", select=f"SELECT {_SAMPLE_COLUMNS} FROM samples WHERE Dataset IN ('{CORPORA[0]}', '{CORPORA[1]}')"))
def catalog_stores(spark, folder):
    """Two stored tags, one in XML and one in Parquet, loaded through the catalog and united."""
    rows, catalog = samples(spark, folder), Catalog()
    for tag, form, write in ((CORPORA[0], "xml", stores.write_xml), (CORPORA[1], "parquet", stores.write_parquet)):
        path = scratch_path(spark, form)
        write(rows.filter(F.col("Dataset") == tag), path)
        catalog.register_store(tag, path, form)
    _, united = catalog.load_all(spark, CORPORA[:2])
    return united.select(*SAMPLE_SCHEMA.names)


@query("source_catalog", sql("samples", select=f"SELECT {_SAMPLE_COLUMNS}, CAST(list_position({list(CORPORA)}, Dataset) - 1 AS INTEGER) AS src_ord FROM samples WHERE Language = 'python'"))
def source_catalog(spark, folder):
    """User-defined sources under their tags, united with a shared filter."""
    from ..operators.filters import languages

    catalog = Catalog()
    for tag in CORPORA:
        catalog.register(tag, lambda s, t=tag: samples(s, folder).drop("sample_id").filter(F.col("Dataset") == t))
    return catalog.load_all(spark, catalog.tags(), [languages(["python"])])[1]


class FolderSource(PositionedSource):
    """Samples of a folder of Parquet files, a position per file in the order of their names."""

    tag = "sample-files"
    stretch = 2
    batch = 3

    def _files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(path))
        return system, sorted(f.path for f in found if f.path.endswith(".parquet"))

    def reach(self):
        return len(self._files()[1])

    def read(self, start, end):
        import pyarrow.parquet as pq

        system, files = self._files()
        for file in files[start:end]:
            # Buffered, so that no column of a whole row group is held.
            with pq.ParquetFile(system.open_input_file(file), buffer_size=1 << 20) as rows:
                for batch in rows.iter_batches(256, columns=SAMPLE_SCHEMA.names):
                    yield batch.select(SAMPLE_SCHEMA.names)


def _sample_files(spark, folder):
    path, rows = scratch_path(spark, "files"), samples(spark, folder).drop("sample_id")
    rows.repartition(parts_for(rows, 7)).write.parquet(path)
    return path if "://" in path else f"file://{path}"


@query("source_by_position", sql("samples", select=f"SELECT {_SAMPLE_COLUMNS} FROM samples"))
def source_by_position(spark, folder):
    """A user's source, read in parts by tasks and loaded through the catalog."""
    catalog = Catalog()
    catalog.register_source(spark, FolderSource, path=_sample_files(spark, folder))
    return catalog.load(spark, FolderSource.tag).select(*SAMPLE_SCHEMA.names)


@query("source_as_stream", sql("samples", select=f"SELECT {_SAMPLE_COLUMNS} FROM samples WHERE Language = 'python'"))
def source_as_stream(spark, folder):
    """The same source as a stream through the ingestion job."""
    from ..operators.filters import languages

    register(spark, FolderSource)
    target, position = scratch_path(spark, "target"), scratch_path(spark, "position")
    stream = stream_source(spark, FolderSource.tag, path=_sample_files(spark, folder))
    ingest.ingest(stream, languages(["python"]), target, position).awaitTermination()
    return spark.read.parquet(target).select(*SAMPLE_SCHEMA.names)


@query("store_with_broken_rows", """SELECT doc_id::VARCHAR AS Prompt, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END || text AS Code FROM documents""")
def store_with_broken_rows(spark, folder):
    """The usual reader of XML stores, over elements of which every third holds a control character."""
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("\x01")).otherwise(F.lit(""))
    path = scratch_path(spark, "broken")
    table(spark, folder, "documents").select(
        F.concat(F.lit('<sample Prompt="'), F.col("doc_id").cast("string"), F.lit('" Code="'), mark, escaped, F.lit('" />')).alias("value")
    ).write.text(path)
    return stores.read_store(spark, path, "xml").select("Prompt", "Code")


@query("source_table", "SELECT text AS Code, item_id::VARCHAR AS Prompt FROM benchmark WHERE length(text) > 100")
def source_table(spark, folder):
    """A downloaded table; rows whose projection has no code are skipped."""
    def project(df):
        code = F.when(F.length("text") > 100, F.col("text"))
        return problems.human_samples(df, "benchmark", code, F.col("item_id").cast("string"), 0)

    catalog = Catalog()
    catalog.register_table("benchmark", f"{folder}/benchmark.parquet", project)
    return catalog.load(spark, "benchmark").select("Code", "Prompt")


@query("store_counts", sql("samples", select="SELECT Dataset, count(*) AS rows FROM samples GROUP BY Dataset"))
def store_counts(spark, folder):
    """Row counts per corpus of a stored table; only its partition folders and footers are read."""
    path = scratch_path(spark, "samples")
    stores.write_parquet(samples(spark, folder), path, partition_by=("Dataset",))
    return st.dataset_counts(stores.read_parquet(spark, path))


# --------------------------------------------------- projections of sources

_HUMAN = """'human' AS Generator, {language} AS Language, {code} AS Code, CAST(NULL AS INTEGER) AS TopK, CAST(NULL AS DOUBLE) AS TopP,
    CAST(NULL AS DOUBLE) AS Temperature, {prompt} AS Prompt, {original} AS OriginalPrompt, {date} AS Date, '{tag}' AS Dataset"""


def _human(tag, code, prompt, date, language="'python'", original=None):
    return _HUMAN.format(tag=tag, code=code, prompt=prompt, date=date, language=language, original=original or prompt)


def _epoch(date):
    return f"CAST({date} AS BIGINT)"


_HALVES = f"""SELECT doc_id AS id, source AS "desc", unnest([({list(SPELLINGS)})[doc_id % 9 + 1], ({list(SPELLINGS)})[(doc_id + 4) % 9 + 1]]) AS lang,
    unnest([substr(text, 1, length(text) // 2), substr(text, length(text) // 2 + 1)]) AS solution FROM documents"""


@query("source_problem_json", sql(("halves", _HALVES), ("rows", "SELECT id, " + _human(problems.PROBLEMS_TAG, "solution", '"desc"', DATE_SQL.format("id"), canonical_sql("lang")) + " FROM halves"),
       select=f"SELECT min(id)::VARCHAR AS id, {_SAMPLE_COLUMNS} FROM rows GROUP BY ALL"))
def source_problem_json(spark, folder):
    """Problems with two solutions each, through JSON files."""
    n, text, half = F.col("doc_id"), F.col("text"), F.floor(F.length("text") / 2).cast("int")
    solutions = F.create_map(
        pick(SPELLINGS, n % 9), F.substring(text, F.lit(1), half),
        pick(SPELLINGS, (n + 4) % 9), F.substring(text, half + 1, F.length(text)),
    )
    path = scratch_path(spark, "problems")
    table(spark, folder, "documents").select(
        n.cast("string").alias("id"), F.col("source").alias("desc"), solutions.alias("solutions")
    ).write.json(path)
    return problems.from_problems(problems.read_problems(spark, path, lines=True))


@query("source_solution_array", "SELECT doc_id, " + _human(problems.SOLUTIONS_TAG, "text", "source", _epoch(problems.SOLUTIONS_DATE)) + " FROM documents")
def source_solution_array(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.to_json(F.array("text", "lang")).alias("solutions"), F.col("source").alias("question")
    )
    return problems.from_solution_arrays(docs, ("doc_id",))


@query("source_function_docs", "SELECT doc_id, " + _human(problems.FUNCTIONS_TAG, "text", "'A function called f' || doc_id || '. Functionality: ' || source",
       _epoch(problems.FUNCTIONS_DATE)) + " FROM documents")
def source_function_docs(spark, folder):
    name = F.concat(F.col("lang"), F.lit(".module.f"), F.col("doc_id").cast("string"))
    docs = table(spark, folder, "documents").select(
        "doc_id", name.alias("func_name"), F.col("source").alias("func_documentation_string"), F.col("text").alias("whole_func_string")
    )
    return problems.from_function_docs(docs, ("doc_id",))


@query("source_reference_code", "SELECT doc_id, " + _human(problems.REFERENCES_TAG, "text", "source", _epoch(problems.REFERENCES_DATE)) + " FROM documents")
def source_reference_code(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("reference_code"), F.col("source").alias("prompt"))
    return problems.from_reference_code(docs, ("doc_id",))


_FENCED_ROWS = f"SELECT doc_id, doc_id * 3 AS pid, ({list(SPELLINGS)})[doc_id % 9 + 1] AS lang, answer FROM fenced"


@query("source_fenced", sql(("fenced", _FENCED), ("rows", _FENCED_ROWS), select="SELECT doc_id, " + _human(problems.FENCED_TAG, f"regexp_extract(answer, '{_FENCE}', 1)",
       "lang", DATE_SQL.format("pid"), canonical_sql("lang"), "pid::VARCHAR") +
       f" FROM rows WHERE regexp_matches(answer, '{_FENCE}') AND {DATE_SQL.format('pid')} < {problems.FENCED_BEFORE}"))
def source_fenced(spark, folder):
    n = F.col("doc_id")
    rows = fenced(spark, folder).select(
        "doc_id", F.col("answer").alias("solution"), pick(SPELLINGS, n % 9).alias("question"),
        (n * 3).alias("problem_id"), pick(SPELLINGS, n % 9).alias("lang"),
    )
    return problems.from_fenced_solutions(rows, ("doc_id",))
