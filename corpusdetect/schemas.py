"""Fixed schemas of the stored tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# The Generator value that marks human-written rows (the negative class).
HUMAN = "human"

SAMPLE_SCHEMA = _struct(
    Generator=_S,
    Language=_S,
    Code=_S,
    TopK=_I,
    TopP=_D,
    Temperature=_D,
    Prompt=_S,
    OriginalPrompt=_S,
    Date=_L,
    Dataset=_S,
)

DETECTION_SCHEMA = _struct(
    PromptHash=_S,
    CodeSampleHash=_S,
    Language=_S,
    Value=_D,
    MaxLength=_I,
    Detector=_S,
    Generator=_S,
    BaseModel=_S,
    SecondaryModel=_S,
    Code=_S,
    TopK=_I,
    TopP=_D,
    Temperature=_D,
    Date=_L,
    Dataset=_S,
)

# One row per (sample, model, position) of logits computed elsewhere.
TOKEN_DIST_SCHEMA = _struct(
    sample_id=_L,
    model=_S,
    pos=_I,
    token_id=_I,
    is_pad=T.BooleanType(),
    logits=T.ArrayType(T.FloatType()),
)

# ``n`` counts how often the same statistics occur in the sample; 1 for a row
# per position, more when equal positions were counted together.
TOKEN_STATS_SCHEMA = _struct(
    sample_id=_L,
    model=_S,
    model2=_S,
    n=_L,
    logprob=_D,
    entropy=_D,
    rank=_D,
    mu=_D,
    var=_D,
    xent=_D,
    is_pad=T.BooleanType(),
)

PROBLEM_SCHEMA = _struct(id=_S, desc=_S, solutions=T.MapType(_S, _S))
SOLUTION_ARRAY_SCHEMA = _struct(question=_S, solutions=_S)
FUNCTION_DOCS_SCHEMA = _struct(func_name=_S, func_documentation_string=_S, whole_func_string=_S)
REFERENCE_CODE_SCHEMA = _struct(reference_code=_S, prompt=_S)
FENCED_SCHEMA = _struct(solution=_S, question=_S, problem_id=_L, lang=_S)


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns, all read as strings (XML attributes, old files)."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])
