"""Source tables of human code: from their published rows to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import canonical_language
from ..functions.text import calendar_epoch, extract_fenced, problem_epoch
from ..operators.setops import first_wins
from ..schemas import HUMAN, PROBLEM_SCHEMA, SAMPLE_SCHEMA

# Tags of the sources and the dates their tables were published.
PROBLEMS_TAG = "leetcode-post"
SOLUTIONS_TAG, SOLUTIONS_DATE = "hf_apps", calendar_epoch(2021, 4, 24)
FUNCTIONS_TAG, FUNCTIONS_DATE = "hf_codesearchnet-python", calendar_epoch(2019, 9, 20)
REFERENCES_TAG, REFERENCES_DATE = "hf_ds1000", calendar_epoch(2022, 10, 1)
FENCED_TAG, FENCED_BEFORE = "hf_leetcode-pre", calendar_epoch(2022, 11, 1)


def human_samples(
    df: DataFrame,
    dataset: str,
    code: Column,
    prompt: Column,
    date: Column | int,
    language: Column | str = "python",
    original_prompt: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Sample rows of human code; ``keep`` carries key columns along."""
    tag = F.lit(language) if isinstance(language, str) else language
    values = {
        "Generator": F.lit(HUMAN),
        "Language": canonical_language(tag),
        "Code": code,
        "Prompt": prompt,
        "OriginalPrompt": prompt if original_prompt is None else original_prompt,
        "Date": F.lit(date) if isinstance(date, int) else date,
        "Dataset": F.lit(dataset),
    }
    missing = F.lit(None)
    return df.select(
        *keep,
        *[values.get(f.name, missing).cast(f.dataType).alias(f.name) for f in SAMPLE_SCHEMA],
    )


def read_problems(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Problem files with id, description and solutions per language.

    A file is one JSON array, or with ``lines`` one object per line, which Spark
    can split between tasks.
    """
    return spark.read.schema(PROBLEM_SCHEMA).option("multiLine", not lines).json(path)


def from_problems(problems: DataFrame) -> DataFrame:
    """One sample per problem and language, dated by the problem's number.

    Equal samples are kept once; as they are equal in every column, it does
    not matter which.
    """
    number = F.col("id").cast("bigint")
    exploded = problems.select("id", "desc", F.explode("solutions").alias("lang", "solution"))
    samples = human_samples(
        exploded, PROBLEMS_TAG, F.col("solution"), F.col("desc"), problem_epoch(number), F.col("lang"), keep=("id",)
    )
    return first_wins(samples, [F.col("id").cast("bigint")])


def from_solution_arrays(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first of the solutions, which are a JSON list in a text column."""
    first = F.get(F.from_json("solutions", "array<string>"), 0)
    return human_samples(df, SOLUTIONS_TAG, first, F.col("question"), SOLUTIONS_DATE, keep=keep)


def from_function_docs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole functions, prompted by name and documentation."""
    name = F.element_at(F.split("func_name", r"\."), -1)
    prompt = F.concat(
        F.lit("A function called "), name, F.lit(". Functionality: "), F.col("func_documentation_string")
    )
    return human_samples(df, FUNCTIONS_TAG, F.col("whole_func_string"), prompt, FUNCTIONS_DATE, keep=keep)


def from_reference_code(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return human_samples(df, REFERENCES_TAG, F.col("reference_code"), F.col("prompt"), REFERENCES_DATE, keep=keep)


def from_fenced_solutions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Code of the first closed fence, of problems from before the cut-off date."""
    samples = human_samples(
        df,
        FENCED_TAG,
        extract_fenced(F.col("solution")),
        F.col("question"),
        problem_epoch(F.col("problem_id")),
        F.col("lang"),
        F.col("problem_id").cast("string"),
        keep,
    )
    return samples.filter(F.col("Code").isNotNull() & (F.col("Date") < FENCED_BEFORE))
