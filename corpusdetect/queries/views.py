"""The driver's tables seen as samples and detections, in Spark and in SQL.

The given tables hold prose, not code; these views assign each document a
generator, a language, a corpus and a sampling setting by its number, so that
every operator has whole-table input. Both forms of a view mean the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGE_ALIASES
from ..schemas import HUMAN

GENERATORS = ("gen-a", "gen-b", "gen-c")
SPELLINGS = ("python3", "js", "c++", "c", "java", "rust", "go", "cs", "perl")
DETECTORS = ("loglikelihood", "entropy", "rank", "fastdetectgpt", "binoculars")
# The corpora that stores are tagged with.
CORPORA = (
    "stackoverflow-pre",
    "stackoverflow-post",
    "hf_apps",
    "hf_codesearchnet-python",
    "hf_leetcode-pre",
    "leetcode-post",
)
# Corpora written before and after generators were in common use.
BEFORE = ("stackoverflow-pre", "hf_apps", "hf_codesearchnet-python", "hf_leetcode-pre")
AFTER = ("stackoverflow-post", "leetcode-post")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values: tuple, position: Column) -> Column:
    """The value at a 0-based position, as a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)


def _pick(values: tuple, position: str) -> str:
    """:func:`pick` as expression text."""
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values)
    return f"element_at(array({listed}), cast({position} as int) + 1)"


def samples(spark: SparkSession, folder: str, raw_language: bool = False) -> DataFrame:
    spelling = _pick(SPELLINGS, "doc_id % 9")
    aliases = ", ".join(f"'{k}', '{v}'" for k, v in LANGUAGE_ALIASES.items())
    language = spelling if raw_language else f"coalesce(try_element_at(map({aliases}), {spelling}), 'generic')"
    generated = "CASE WHEN doc_id % 4 <> 0 THEN"
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS sample_id",
        f"{_pick((HUMAN, *GENERATORS), 'doc_id % 4')} AS Generator",
        f"{language} AS Language",
        "text AS Code",
        "CAST(NULL AS int) AS TopK",
        f"{generated} {_pick((0.95, 0.5, 0.95, 0.5), '(doc_id div 4) % 4')} END AS TopP",
        f"{generated} {_pick((0.97, 0.97, 0.2, 0.2), '(doc_id div 4) % 4')} END AS Temperature",
        "text AS Prompt",
        "text AS OriginalPrompt",
        "1420070400 + doc_id * 86400 AS Date",
        f"{_pick(CORPORA, '(doc_id div 16) % 6')} AS Dataset",
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic scores of every sample for five detectors and three base models."""
    combos = ", ".join(
        f"struct({d} AS d, '{name}' AS Detector, {b} AS b, '{base}' AS BaseModel)"
        for d, name in enumerate(DETECTORS)
        for b, base in enumerate(GENERATORS)
    )
    kept = ["sample_id", "Generator", "Language", "TopP", "Temperature", "Dataset"]
    return (
        samples(spark, folder)
        .selectExpr(*kept, f"inline(array({combos}))")
        .selectExpr(
            *kept,
            "Detector",
            "BaseModel",
            f"CASE WHEN d >= 3 THEN {_pick(GENERATORS[:2], '(sample_id div 4) % 2')} END AS SecondaryModel",
            """CASE WHEN sample_id % 97 = 0 THEN double('NaN')
                 WHEN sample_id % 89 = 0 THEN double('Infinity')
                 WHEN sample_id % 83 = 0 THEN double('-Infinity')
                 WHEN sample_id % 79 = 0 THEN NULL
                 ELSE ((sample_id * 37 + d * 11 + b * 17) % 101) / 101D
                    + CASE WHEN Generator = BaseModel THEN 0.25D WHEN Generator <> 'human' THEN 0.1D
                           ELSE 0D END END AS Value""",
        )
    )


def _case(subject: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {subject} {arms} ELSE {default} END"


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" for v in values) + "]"


def canonical_sql(subject: str) -> str:
    return _case(subject, LANGUAGE_ALIASES, "'generic'")


_SPELLING = f"({_list(SPELLINGS)})[doc_id % 9 + 1]"
_GENERATOR = f"({_list((HUMAN, *GENERATORS))})[doc_id % 4 + 1]"


def _samples_sql(language: str) -> str:
    return f"""SELECT doc_id AS sample_id, {_GENERATOR} AS Generator, {language} AS Language,
      text AS Code, CAST(NULL AS INTEGER) AS TopK,
      CASE WHEN doc_id % 4 <> 0 THEN ({_list((0.95, 0.5, 0.95, 0.5))})[(doc_id // 4) % 4 + 1] END AS TopP,
      CASE WHEN doc_id % 4 <> 0 THEN ({_list((0.97, 0.97, 0.2, 0.2))})[(doc_id // 4) % 4 + 1] END AS Temperature,
      text AS Prompt, text AS OriginalPrompt,
      1420070400 + doc_id * 86400 AS Date,
      ({_list(CORPORA)})[(doc_id // 16) % 6 + 1] AS Dataset
    FROM documents"""


_DETECTIONS_SQL = f"""SELECT sample_id, Generator, Language, TopP, Temperature, Dataset,
      ({_list(DETECTORS)})[d + 1] AS Detector, ({_list(GENERATORS)})[b + 1] AS BaseModel,
      CASE WHEN d >= 3 THEN ({_list(GENERATORS[:2])})[(sample_id // 4) % 2 + 1] END AS SecondaryModel,
      CASE WHEN sample_id % 97 = 0 THEN 'NaN'::DOUBLE
           WHEN sample_id % 89 = 0 THEN 'Infinity'::DOUBLE
           WHEN sample_id % 83 = 0 THEN '-Infinity'::DOUBLE
           WHEN sample_id % 79 = 0 THEN NULL
           ELSE ((sample_id * 37 + d * 11 + b * 17) % 101) / 101e0
              + CASE WHEN Generator = ({_list(GENERATORS)})[b + 1] THEN 0.25e0
                     WHEN Generator <> 'human' THEN 0.1e0 ELSE 0e0 END END AS Value
    FROM samples, (SELECT unnest(range(5)) AS d), (SELECT unnest(range(3)) AS b)"""

CTES = {
    "samples": _samples_sql(canonical_sql(_SPELLING)),
    "raw_samples": _samples_sql(_SPELLING),
    "detections": _DETECTIONS_SQL,
}


_NL = "chr(10)"
SAMPLE_HASH = f"""sha256('PL: ' || Language || {_NL} || 'Code: ' || Code || {_NL} || {_NL} || {_NL}
    || 'Dataset: ' || Dataset || {_NL} || 'Generator: ' || Generator || {_NL} || 'Prompt: ' || Prompt || {_NL}
    || 'Original Prompt: ' || OriginalPrompt || {_NL} || 'Date: ' || Date || {_NL}
    || 'Temperature: ' || coalesce(Temperature::VARCHAR, 'None') || {_NL}
    || 'Top-p: ' || coalesce(TopP::VARCHAR, 'None') || {_NL} || 'Top-k: ' || coalesce(TopK::VARCHAR, 'None'))"""


def sql(*ctes: str | tuple[str, str], select: str) -> str:
    """A statement over named views; a pair defines a further one on the spot."""
    named = [(c, CTES[c]) if isinstance(c, str) else c for c in ctes]
    # A name with a column list is recursive; all others are computed once.
    parts = [f"{name} AS {'' if '(' in name else 'MATERIALIZED '}({body})" for name, body in named]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
