"""Programming-language tags, names and comment syntax as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = "generic"

# Accepted spellings and the canonical tag each is stored under.
LANGUAGE_ALIASES = {
    "python": "python",
    "python3": "python",
    "python2": "python",
    "py": "python",
    "javascript": "js",
    "js": "js",
    "c": "c",
    "cpp": "cpp",
    "c++": "cpp",
    "java": "java",
    "rust": "rust",
    "go": "go",
    "c#": "csharp",
    "csharp": "csharp",
    "cs": "csharp",
}

# The name used for a language in natural-language prompts.
DISPLAY_NAMES = {
    "python": "Python",
    "js": "JavaScript",
    "c": "C",
    "cpp": "C++",
    "java": "Java",
    "rust": "Rust",
    "go": "Go",
    "csharp": "C#",
    "generic": "any programming language (or described later)",
}

# Languages with a documentation-comment form of their own.
DOC_COMMENT_LANGUAGES = ("csharp", "java", "rust")

# Every character at which a text breaks into lines; CRLF counts once.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def canonical_language(language: Column) -> Column:
    """Canonical tag of any spelling; unknown spellings and null are generic."""
    return F.coalesce(_lookup(LANGUAGE_ALIASES, language), F.lit(GENERIC))


def display_name(canonical: Column) -> Column:
    return _lookup(DISPLAY_NAMES, canonical)


def to_comment(canonical: Column, text: Column, documentation: bool = False) -> Column:
    """``text`` as a comment of the language.

    ``documentation`` selects the documentation form where the language has
    one; elsewhere the ordinary comment is used.
    """
    multi_line = F.contains(text, F.lit("\n"))
    plain = (
        F.when(
            canonical == "python",
            F.when(multi_line, F.concat(F.lit('"""\n'), text, F.lit('\n"""'))).otherwise(
                F.concat(F.lit("#"), text)
            ),
        )
        .when(multi_line, F.concat(F.lit("/*\n"), text, F.lit("\n*/")))
        .otherwise(F.concat(F.lit("//"), text))
    )
    if not documentation:
        return plain
    # A break at the very end opens no further line.
    marked = F.regexp_replace(text, f"({LINE_BREAK})(?=[\\s\\S])", "$1///")
    return F.when(
        canonical.isin(*DOC_COMMENT_LANGUAGES), F.concat(F.lit("///"), marked)
    ).otherwise(plain)
