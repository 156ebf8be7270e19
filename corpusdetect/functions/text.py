"""Hashing, prompts, output clean-up and dates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import GENERIC, display_name, to_comment

# Patterns for code between fences (whole texts, dot matches all).
FENCE = r"(?s)`{3}[a-z|+]*[\r\n|\n]*(.*?)[\r\n]`{3}"
FULL_BLOCK = r"(?s)(\\begin\{code\}|`{3}[a-z|+]*[\r\n|\n]*)(.*)([\r\n]`{3}|\\end\{code\})"
OPEN_BLOCK = r"(?s)(\\begin\{code\}|`{3}[a-z|+]*[\r\n|\n]*)(.*)"

# The regression of a problem's publication day on its number.
DAY_SLOPE = 0.7799434140207482
DAY_INTERCEPT = 1827.357277250333
DAY_SCALE = 1.044161253570283
DAY_ZERO = datetime.date(2022, 6, 24)

# Wording of the instruction prompt.
INSTRUCTION_HEAD = "In "
INSTRUCTION_TASK = ", write some code with the following functionality: "
INSTRUCTION_TAIL = (
    ".\n\nDo not explain the code, only return the code and comments if necessary. "
    "DO NOT REPEAT YOURSELF! Only explain things in the comments of code. "
    "Otherwise do not write any plain text. Start with the code here:\n"
)

PROMPT_FORMATS = ("doc_comment", "language_comment", "named_language_comment", "instruction")

# Least number of new tokens a generator may use when none is configured.
DEFAULT_BUDGET = 256


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def sample_hash(
    language: Column,
    code: Column,
    dataset: Column,
    generator: Column,
    prompt: Column,
    original_prompt: Column,
    date: Column,
    temperature: Column,
    top_p: Column,
    top_k: Column,
) -> Column:
    """SHA-256 of the sample's text form; nulls are written ``None``.

    ``date`` is whole epoch seconds. A double would print in exponent form.
    """
    labelled = [
        ("PL: ", language),
        ("\nCode: ", code),
        ("\n\n\nDataset: ", dataset),
        ("\nGenerator: ", generator),
        ("\nPrompt: ", prompt),
        ("\nOriginal Prompt: ", original_prompt),
        ("\nDate: ", date),
        ("\nTemperature: ", temperature),
        ("\nTop-p: ", top_p),
        ("\nTop-k: ", top_k),
    ]
    parts = [part for label, value in labelled for part in (F.lit(label), _shown(value))]
    return F.sha2(F.concat(*parts), 256)


def sample_row_hash() -> Column:
    """:func:`sample_hash` over the columns of the sample schema."""
    names = (
        "Language Code Dataset Generator Prompt OriginalPrompt Date Temperature TopP TopK".split()
    )
    return sample_hash(*[F.col(n) for n in names])


def prompt_hash(original_prompt: Column) -> Column:
    return F.sha2(_shown(original_prompt), 256)


def prompt_text(prompt_format: str, canonical: Column, prompt: Column) -> Column:
    """The text handed to a generator.

    ``doc_comment`` documents a function, ``language_comment`` names the
    language first, ``named_language_comment`` does so unless it is generic,
    ``instruction`` asks in a sentence.
    """
    if prompt_format == "doc_comment":
        return F.concat(to_comment(canonical, prompt, documentation=True), F.lit("\n"))
    if prompt_format == "instruction":
        return F.concat(
            F.lit(INSTRUCTION_HEAD),
            display_name(canonical),
            F.lit(INSTRUCTION_TASK),
            prompt,
            F.lit(INSTRUCTION_TAIL),
        )
    task = F.concat(to_comment(canonical, F.concat(F.lit(" "), prompt)), F.lit("\n"))
    headed = F.concat(
        to_comment(canonical, F.concat(F.lit(" language: "), canonical)), F.lit("\n"), task
    )
    if prompt_format == "language_comment":
        return headed
    if prompt_format == "named_language_comment":
        return F.when(canonical == GENERIC, task).otherwise(headed)
    raise ValueError(f"unknown prompt format {prompt_format!r}")


def prompt_by_format(prompt_format: Column, canonical: Column, prompt: Column) -> Column:
    """:func:`prompt_text` with the format taken from a column."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in PROMPT_FORMATS:
        chosen = chosen.when(prompt_format == name, prompt_text(name, canonical, prompt))
    return chosen


def extract_fenced(text: Column) -> Column:
    """Code in the first closed fence, null where there is none."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1))


def clean_output(text: Column) -> Column:
    """Code of a closed block, else of an open block, else the text itself."""
    return (
        F.when(text.rlike(FULL_BLOCK), F.regexp_extract(text, FULL_BLOCK, 2))
        .when(text.rlike(OPEN_BLOCK), F.regexp_extract(text, OPEN_BLOCK, 2))
        .otherwise(text)
    )


def strip_prompt(output: Column, prompt: Column) -> Column:
    """Drop as many leading characters as the prompt has."""
    return F.substring(output, F.length(prompt) + 1, F.length(output))


def output_budget(
    model_max: Column,
    prompt_tokens: Column,
    sample_tokens: Column | None = None,
    fixed: int = DEFAULT_BUDGET,
) -> Column:
    """New tokens a generator may write: at least 1, at most what the model holds.

    With ``sample_tokens`` the budget grows with the human sample (a quarter
    more than its tokens, not below the default); otherwise it is ``fixed``.
    """
    wanted = F.lit(fixed)
    if sample_tokens is not None:
        wanted = F.greatest(
            F.floor(sample_tokens * F.lit(1.25)).cast("int"), F.lit(DEFAULT_BUDGET)
        )
    return F.greatest(F.lit(1), F.least(model_max - prompt_tokens, wanted))


def calendar_epoch(year: int, month: int, day: int) -> int:
    """Epoch seconds of midnight UTC."""
    return (datetime.date(year, month, day) - datetime.date(1970, 1, 1)).days * 86400


def problem_epoch(problem_id: Column) -> Column:
    """Estimated publication day of a numbered problem, as epoch seconds."""
    day = (problem_id.cast("double") * F.lit(DAY_SLOPE) - F.lit(DAY_INTERCEPT)) / F.lit(DAY_SCALE)
    date = F.date_add(F.lit(DAY_ZERO), F.floor(day).cast("int"))
    return F.unix_date(date).cast("bigint") * F.lit(86400)
