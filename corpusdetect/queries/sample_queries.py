"""Filters, set operations, grouping, scalar functions and token counts over samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages as lang
from ..functions import text as tx
from ..functions.scores import default_setting
from ..functions.tokens import (
    characters,
    decode_ids,
    encode_ids,
    join_tokens,
    token_count,
    vocabulary,
    words,
    words_and_marks,
)
from ..plans.storage import materialize
from ..operators import filters as flt
from ..operators import frequencies as fq
from ..operators import grouping as gp
from ..operators import setops as so
from ..operators import statistics as st
from .registry import query, r6, sql6
from .views import BEFORE, CORPORA, GENERATORS, SAMPLE_HASH, canonical_sql, detections, pick, samples, sql, table

_WORDS = r"regexp_extract_all(Code, '\S+')"
_SETTING = "((TopP = 0.95e0 AND Temperature = 0.97e0) OR Generator = 'human')"
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _ids(df):
    return df.select("sample_id")


# ------------------------------------------------------------------ filters


@query("filter_after_date", sql("samples", select="SELECT sample_id FROM samples WHERE Date > 1433289600"))
def filter_after_date(spark, folder):
    return _ids(flt.after_date((2015, 6, 3))(samples(spark, folder)))


@query("filter_before_date", sql("samples", select="SELECT sample_id FROM samples WHERE Date < 1433289600"))
def filter_before_date(spark, folder):
    return _ids(flt.before_date(1433289600)(samples(spark, folder)))


@query("filter_language", sql("samples", select="SELECT sample_id, Language FROM samples WHERE Language IN ('python', 'cpp', 'generic')"))
def filter_language(spark, folder):
    keep = flt.languages(["python", "cpp", "generic"])
    rows = keep(samples(spark, folder, raw_language=True))
    return rows.select("sample_id", lang.canonical_language(F.col("Language")).alias("Language"))


@query("filter_length", sql("samples", select=f"SELECT sample_id FROM samples WHERE len({_WORDS}) >= 50 AND len({_WORDS}) < 500 AND (len({_WORDS}) - 50) % 3 = 0"))
def filter_length(spark, folder):
    return _ids(flt.length(range(50, 500, 3), words)(samples(spark, folder)))


@query("filter_distribution", sql("samples", ("keep", f"SELECT DISTINCT {SAMPLE_HASH} AS hash FROM samples JOIN labels ON doc_id = sample_id WHERE quality = 1"),
       select=f"SELECT sample_id FROM samples WHERE {SAMPLE_HASH} IN (SELECT hash FROM keep)"))
def filter_distribution(spark, folder):
    """Samples in a hash list: those that were labelled as good."""
    rows = samples(spark, folder)
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("sample_id"))
    hashes = rows.join(good, "sample_id", "left_semi").select(tx.sample_row_hash().alias("hash"))
    return _ids(flt.distribution(hashes)(rows))


@query("filter_index", sql("samples", ("n", "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM samples WHERE Language = 'python'"),
       select="SELECT sample_id FROM n WHERE i >= 5 AND i < 60 AND (i - 5) % 2 = 0"))
def filter_index(spark, folder):
    keep = flt.chain([flt.languages(["python"]), flt.index(range(5, 60, 2), [F.col("sample_id")])])
    return _ids(keep(samples(spark, folder)))


@query("filter_chain", sql("samples", select=f"SELECT sample_id FROM samples WHERE Language IN ('python', 'java') AND Date > 1422230400 AND len({_WORDS}) < 400 AND Dataset IN ('hf_apps', 'leetcode-post')"))
def filter_chain(spark, folder):
    keep = flt.chain([
        flt.languages(["python", "java"]), flt.after_date((2015, 1, 26)), flt.length(range(0, 400)), flt.corpus(["hf_apps", "leetcode-post"]),
    ])
    return _ids(keep(samples(spark, folder)))


@query("filter_setting", sql("samples", select=f"SELECT sample_id, Generator FROM samples WHERE {_SETTING}"))
def filter_setting(spark, folder):
    return samples(spark, folder).filter(default_setting()).select("sample_id", "Generator")


@query("filter_custom", sql("samples", select="SELECT sample_id FROM samples WHERE Code LIKE '%the%'"))
def filter_custom(spark, folder):
    return _ids(flt.where(F.col("Code").contains("the"))(samples(spark, folder)))


_CAPABLE = [("code-a", name) for name in lang.DISPLAY_NAMES] + [("code-b", "python"), ("code-c", "python"), ("code-c", "java")]
_CAPABLE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{n}')" for m, n in _CAPABLE) + ") c(model, Language)"
_CAPABLE_MODELS = ("code-a", "code-b", "code-c", "code-d")


def _capability(spark):
    return spark.createDataFrame(_CAPABLE, "model string, Language string")


@query("capability_supported", sql("samples", ("capability", _CAPABLE_SQL), select="SELECT sample_id, model, Language FROM samples JOIN capability USING (Language)"))
def capability_supported(spark, folder):
    return flt.supported(samples(spark, folder).select("sample_id", "Language"), _capability(spark))


@query("capability_unsupported", sql("samples", ("capability", _CAPABLE_SQL), select=f"""SELECT sample_id, m.model, Language
       FROM samples, (SELECT unnest({list(_CAPABLE_MODELS)}) AS model) m WHERE NOT EXISTS
       (SELECT 1 FROM capability c WHERE c.model = m.model AND c.Language = samples.Language)"""))
def capability_unsupported(spark, folder):
    return flt.unsupported(samples(spark, folder).select("sample_id", "Language"), _capability(spark), _CAPABLE_MODELS)


# ---------------------------------------------------------- set operations


def _parts(spark, folder):
    rows = samples(spark, folder).select("sample_id", "Generator", "Dataset", "Language")
    return [rows.filter(F.col("Dataset") == c) for c in CORPORA]


@query("union_ordered", sql("samples", select=f"SELECT sample_id, Generator, Dataset, Language, CAST(list_position({list(CORPORA)}, Dataset) - 1 AS INTEGER) AS src_ord FROM samples"))
def union_ordered(spark, folder):
    return so.concatenate(_parts(spark, folder))


@query("filter_propagation", sql("samples", select=f"SELECT sample_id, Generator, Dataset, Language, CAST(list_position({list(CORPORA)}, Dataset) - 1 AS INTEGER) AS src_ord FROM samples WHERE Language = 'python'"))
def filter_propagation(spark, folder):
    """A filter on a union reaches every child's scan."""
    return flt.languages(["python"])(so.concatenate(_parts(spark, folder)))


@query("union_missing_columns", """SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS role FROM documents
       UNION ALL SELECT conv_id, NULL, role FROM conversations""")
def union_missing_columns(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "role")
    return so.concatenate_frames([docs, turns])


@query("dedupe_first_wins", """SELECT min(doc_id) AS doc_id, lang, sha256(text) AS text_hash FROM documents GROUP BY text, lang""")
def dedupe_first_wins(spark, folder):
    """Copies within a language keep their first document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return so.first_wins(docs, [F.col("doc_id")], F.concat_ws("|", "text_hash", "lang"))


@query("dedupe_pages", """SELECT min(page_id) AS page_id, sha256(html) AS html_hash FROM pages GROUP BY html""")
def dedupe_pages(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.sha2("html", 256).alias("html_hash"))
    return so.first_wins(pages, [F.col("page_id")], F.col("html_hash"))


@query("interlace", sql("samples", select="SELECT sample_id // 4 AS source_id, CAST(list_position(['human', 'gen-a', 'gen-b', 'gen-c'], Generator) - 1 AS BIGINT) AS gen_ord, sample_id, Generator FROM samples"))
def interlace(spark, folder):
    """Four consecutive documents stand for a human sample and its three outputs."""
    rows = samples(spark, folder).select(
        F.floor(F.col("sample_id") / 4).alias("source_id"), "sample_id", "Generator"
    )
    return so.interlace(rows, "source_id", GENERATORS)


@query("combined_tag", sql("samples", select=f"SELECT '{'-'.join(CORPORA)}' AS Dataset, count(*) AS rows FROM samples"))
def combined_tag(spark, folder):
    union = so.concatenate(_parts(spark, folder))
    return st.dataset_counts(union.withColumn("Dataset", F.lit(so.combined_tag(CORPORA))))


# ---------------------------------------------------------------- grouping


def _group_sql(rule):
    return sql("samples", ("sized", f"SELECT sample_id, CAST(len({_WORDS}) AS INTEGER) AS length FROM samples"),
               ("lens", "SELECT DISTINCT length AS n FROM sized"),
               ("anchors(a)", f"SELECT min(n) FROM lens UNION ALL SELECT min(n) FROM anchors JOIN lens ON {rule} GROUP BY a"),
               ("firsts", "SELECT a, CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS size_group FROM anchors"),
               select="SELECT sample_id, length, max(size_group) AS size_group FROM sized LEFT JOIN firsts ON a <= length GROUP BY ALL")


def _sized(spark, folder):
    return samples(spark, folder).select("sample_id", token_count(words(F.col("Code"))).alias("length"))


@query("size_groups_relative", _group_sql("n - a > n * 0.25e0"))
def size_groups_relative(spark, folder):
    return gp.size_groups(_sized(spark, folder), "length", 0.25)


@query("size_groups_null_length", _group_sql("n - a > 100").replace(f"CAST(len({_WORDS}) AS INTEGER)", f"CASE WHEN sample_id % 7 <> 0 THEN CAST(len({_WORDS}) AS INTEGER) END")
       .replace("FROM sized),", "FROM sized WHERE length IS NOT NULL),", 1))
def size_groups_null_length(spark, folder):
    """Rows without a length are kept, in no group."""
    rows = _sized(spark, folder).withColumn("length", F.when(F.col("sample_id") % 7 != 0, F.col("length")))
    return gp.size_groups(rows, "length", 100)


@query("size_groups_absolute", _group_sql("n - a > 100"))
def size_groups_absolute(spark, folder):
    return gp.size_groups(_sized(spark, folder), "length", 100)


@query("running_index", """SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS index FROM documents""")
def running_index(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return gp.running_index(docs, [F.col("source"), F.col("doc_id")])


@query("paging", sql("samples", ("n", f"SELECT sample_id, (row_number() OVER (ORDER BY list_position({list(CORPORA)}, Dataset), sample_id) - 1) // 8 AS batch_id FROM samples"),
       select="SELECT sample_id, batch_id, batch_id = max(batch_id) OVER () AS final FROM n"))
def paging(spark, folder):
    """Batches of eight across the borders of the united corpora."""
    union = so.concatenate(_parts(spark, folder))
    return gp.pages(union, [F.col("src_ord"), F.col("sample_id")], 8).select("sample_id", "batch_id", "final")


# -------------------------------------------------------- scalar functions


@query("sample_hash", sql("samples", select=f"SELECT sample_id, {SAMPLE_HASH} AS hash FROM samples"))
def sample_hash(spark, folder):
    return samples(spark, folder).select("sample_id", tx.sample_row_hash().alias("hash"))


@query("prompt_hash", sql("samples", select="SELECT sample_id, sha256(OriginalPrompt) AS hash FROM samples"))
def prompt_hash(spark, folder):
    return samples(spark, folder).select("sample_id", tx.prompt_hash(F.col("OriginalPrompt")).alias("hash"))


@query("language_canonical", sql("raw_samples", select=f"SELECT sample_id, Language AS spelling, {canonical_sql('Language')} AS canonical FROM raw_samples"))
def language_canonical(spark, folder):
    rows = samples(spark, folder, raw_language=True)
    return rows.select("sample_id", F.col("Language").alias("spelling"), lang.canonical_language(F.col("Language")).alias("canonical"))


_DISPLAY = "CASE Language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.DISPLAY_NAMES.items()) + " END"


@query("language_display", sql("samples", select=f"SELECT sample_id, {_DISPLAY} AS name FROM samples"))
def language_display(spark, folder):
    return samples(spark, folder).select("sample_id", lang.display_name(F.col("Language")).alias("name"))


def comment_sql(text, language="Language"):
    return f"""CASE WHEN {language} = 'python' THEN CASE WHEN contains({text}, chr(10)) THEN '\"\"\"' || chr(10) || {text} || chr(10) || '\"\"\"' ELSE '#' || {text} END
      WHEN contains({text}, chr(10)) THEN '/*' || chr(10) || {text} || chr(10) || '*/' ELSE '//' || {text} END"""


def doc_comment_sql(text, language="Language"):
    marked = f"regexp_replace({text}, '({_LINES})', '\\1///', 'g')"
    return f"""CASE WHEN {language} IN ('csharp', 'java', 'rust') THEN '///' || CASE WHEN regexp_matches({text}, '({_LINES})$')
      THEN left({marked}, length({marked}) - 3) ELSE {marked} END ELSE {comment_sql(text, language)} END"""


@query("to_comment", sql("samples", select=f"SELECT sample_id, {comment_sql('Code')} AS comment FROM samples"))
def to_comment(spark, folder):
    return samples(spark, folder).select("sample_id", lang.to_comment(F.col("Language"), F.col("Code")).alias("comment"))


@query("to_doc_comment", sql("samples", select=f"SELECT sample_id, {doc_comment_sql('Code')} AS comment FROM samples"))
def to_doc_comment(spark, folder):
    made = lang.to_comment(F.col("Language"), F.col("Code"), documentation=True)
    return samples(spark, folder).select("sample_id", made.alias("comment"))


def _quote(value):
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt_sql(prompt="Code"):
    task = comment_sql(f"(' ' || {prompt})") + " || chr(10)"
    headed = f"({comment_sql("(' language: ' || Language)")}) || chr(10) || ({comment_sql(f"(' ' || {prompt})")}) || chr(10)"
    return {
        "doc_comment": f"({doc_comment_sql(prompt)}) || chr(10)",
        "language_comment": headed,
        "named_language_comment": f"CASE WHEN Language = 'generic' THEN ({task.removesuffix(' || chr(10)')}) || chr(10) ELSE {headed} END",
        "instruction": f"{_quote(tx.INSTRUCTION_HEAD)} || {_DISPLAY} || {_quote(tx.INSTRUCTION_TASK)} || {prompt} || {_quote(tx.INSTRUCTION_TAIL)}",
    }


@query("prompt_formats", sql("samples", select="\nUNION ALL ".join(
       f"SELECT sample_id, '{name}' AS prompt_format, {text} AS prompt FROM samples" for name, text in prompt_sql().items())))
def prompt_formats(spark, folder):
    names = F.array(*[F.lit(n) for n in tx.PROMPT_FORMATS])
    rows = samples(spark, folder).withColumn("prompt_format", F.explode(names))
    text = tx.prompt_by_format(F.col("prompt_format"), F.col("Language"), F.col("Code"))
    return rows.select("sample_id", "prompt_format", text.alias("prompt"))


# A closed fence, an open one, a code environment, or none, by document number.
_FENCED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN 'Sure: ```' || chr(10) || text WHEN 2 THEN '\\begin{code}' || text || '\\end{code} ok' ELSE text END AS answer FROM documents"""


def fenced(spark, folder):
    doc, text = F.col("doc_id"), F.col("text")
    answer = (
        F.when(doc % 4 == 0, F.concat(F.lit("Sure:\n```python\n"), text, F.lit("\n```\nDone.")))
        .when(doc % 4 == 1, F.concat(F.lit("Sure: ```\n"), text))
        .when(doc % 4 == 2, F.concat(F.lit("\\begin{code}"), text, F.lit("\\end{code} ok")))
        .otherwise(text)
    )
    return table(spark, folder, "documents").select("doc_id", answer.alias("answer"))


_FENCE = tx.FENCE.replace("'", "''")


@query("extract_fenced", sql(("fenced", _FENCED), select=f"SELECT doc_id, CASE WHEN regexp_matches(answer, '{_FENCE}') THEN regexp_extract(answer, '{_FENCE}', 1) END AS code FROM fenced"))
def extract_fenced(spark, folder):
    return fenced(spark, folder).select("doc_id", tx.extract_fenced(F.col("answer")).alias("code"))


@query("clean_output", sql(("fenced", _FENCED), select=f"""SELECT doc_id, CASE WHEN regexp_matches(answer, '{tx.FULL_BLOCK}') THEN regexp_extract(answer, '{tx.FULL_BLOCK}', 2)
       WHEN regexp_matches(answer, '{tx.OPEN_BLOCK}') THEN regexp_extract(answer, '{tx.OPEN_BLOCK}', 2) ELSE answer END AS code FROM fenced"""))
def clean_output(spark, folder):
    return fenced(spark, folder).select("doc_id", tx.clean_output(F.col("answer")).alias("code"))


@query("strip_prompt", sql("samples", select="SELECT sample_id, substr(Prompt || Code, length(Prompt) + 1) AS output FROM samples"))
def strip_prompt(spark, folder):
    rows = samples(spark, folder)
    return rows.select("sample_id", tx.strip_prompt(F.concat("Prompt", "Code"), F.col("Prompt")).alias("output"))


@query("output_budget", sql("samples", select=f"""SELECT sample_id,
       CAST(greatest(1, least(2048 - length(Prompt), greatest(CAST(floor(len({_WORDS}) * 1.25e0) AS INTEGER), 256))) AS INTEGER) AS dynamic,
       CAST(greatest(1, least(2048 - length(Prompt), 256)) AS INTEGER) AS fixed FROM samples"""))
def output_budget(spark, folder):
    limit, prompt = F.lit(2048), F.length("Prompt")
    own = token_count(words(F.col("Code")))
    return samples(spark, folder).select(
        "sample_id",
        tx.output_budget(limit, prompt, own).alias("dynamic"),
        tx.output_budget(limit, prompt).alias("fixed"),
    )


DATE_SQL = (
    f"epoch(DATE '2022-06-24' + CAST(floor(({{0}}::DOUBLE * {tx.DAY_SLOPE}e0 - {tx.DAY_INTERCEPT}e0) / {tx.DAY_SCALE}e0) AS INTEGER))::BIGINT"
)


@query("date_regression", f"SELECT doc_id, {DATE_SQL.format('doc_id')} AS Date FROM documents")
def date_regression(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.problem_epoch(F.col("doc_id")).alias("Date"))


# -------------------------------------------------------- counts and tokens


@query("dataset_counts", sql("samples", select="SELECT Dataset, count(*) AS rows FROM samples GROUP BY Dataset"))
def dataset_counts(spark, folder):
    return st.dataset_counts(samples(spark, folder))


@query("value_counts", sql("samples", select="SELECT Generator AS value, count(*) AS rows FROM samples GROUP BY Generator"))
def value_counts(spark, folder):
    return st.value_counts(samples(spark, folder), "Generator")


_COUNTED = ["sample_id", "Generator", "Language", "TopP", "Temperature", "Dataset", "Detector", "BaseModel", "SecondaryModel", "Value"]


@query("column_counts", sql("samples", "detections", select=" UNION ALL ".join(
       f"""SELECT '{c}' AS "column", count({c}) AS "values" FROM detections""" for c in _COUNTED)))
def column_counts(spark, folder):
    return st.column_counts(detections(spark, folder).select(*_COUNTED))


@query("token_counts", sql("samples", select=rf"""SELECT sample_id, CAST(len({_WORDS}) AS INTEGER) AS words,
       CAST(len(regexp_extract_all(Code, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS INTEGER) AS marks, CAST(length(Code) AS INTEGER) AS characters FROM samples"""))
def token_counts(spark, folder):
    code = F.col("Code")
    return samples(spark, folder).select(
        "sample_id",
        token_count(words(code)).alias("words"),
        token_count(words_and_marks(code)).alias("marks"),
        token_count(characters(code)).alias("characters"),
    )


@query("detokenise", sql("samples", select=f"SELECT sample_id, array_to_string({_WORDS}, ' ') AS text FROM samples"))
def detokenise(spark, folder):
    return samples(spark, folder).select("sample_id", join_tokens(words(F.col("Code"))).alias("text"))


_FREQ = f"SELECT Generator, token, count(*) AS cnt FROM (SELECT Generator, unnest({_WORDS}) AS token FROM samples WHERE {_SETTING}) GROUP BY ALL"


@query("vocabulary", sql("samples", ("freq", _FREQ), select="SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS token_id FROM (SELECT DISTINCT token FROM freq)"))
def vocabulary_ids(spark, folder):
    return vocabulary(_frequencies(spark, folder))


def _frequencies(spark, folder, by=("Generator",)):
    return fq.token_frequencies(samples(spark, folder).filter(default_setting()), by)


@query("token_frequency", sql("samples", ("freq", _FREQ), select="SELECT * FROM freq"))
def token_frequency(spark, folder):
    return _frequencies(spark, folder)


_FREQ_SET = f"SELECT Dataset, Generator, token, count(*) AS cnt FROM (SELECT Dataset, Generator, unnest({_WORDS}) AS token FROM samples WHERE {_SETTING}) GROUP BY ALL"


@query("token_frequency_by_dataset", sql("samples", ("freq", _FREQ_SET), select="SELECT * FROM freq"))
def token_frequency_by_dataset(spark, folder):
    return _frequencies(spark, folder, ("Dataset", "Generator"))


@query("token_share", sql("samples", ("freq", _FREQ), select=f"""SELECT Generator, token, cnt, CAST(sum(cnt) OVER (PARTITION BY Generator) AS BIGINT) AS total,
       {sql6('cnt / (sum(cnt) OVER (PARTITION BY Generator))::DOUBLE')} AS share FROM freq"""))
def token_share(spark, folder):
    return fq.token_shares(_frequencies(spark, folder)).withColumn("share", r6("share"))


_NULL_SLICE = "CASE WHEN sample_id % 3 <> 0 THEN Dataset END"
_FREQ_NULL = f"SELECT Dataset, Generator, token, count(*) AS cnt FROM (SELECT {_NULL_SLICE} AS Dataset, Generator, unnest({_WORDS}) AS token FROM samples WHERE {_SETTING}) GROUP BY ALL"


@query("token_share_null_slice", sql("samples", ("freq", _FREQ_NULL), select=f"""SELECT Dataset, Generator, token, cnt, CAST(sum(cnt) OVER (PARTITION BY Dataset, Generator) AS BIGINT) AS total,
       {sql6('cnt / (sum(cnt) OVER (PARTITION BY Dataset, Generator))::DOUBLE')} AS share FROM freq"""))
def token_share_null_slice(spark, folder):
    """Shares within slices of which one has no name."""
    rows = samples(spark, folder).filter(default_setting()).withColumn("Dataset", F.expr(_NULL_SLICE))
    by = ("Dataset", "Generator")
    return fq.token_shares(fq.token_frequencies(rows, by), by).withColumn("share", r6("share"))


def _compare(by=""):
    on = f"{by}, " if by else ""
    return f"""SELECT {on}Generator, token, hc / hsum::DOUBLE AS x, ac / asum::DOUBLE AS y FROM
      (SELECT *, sum(hc) OVER (PARTITION BY {on}Generator) AS hsum, sum(ac) OVER (PARTITION BY {on}Generator) AS asum FROM
        (SELECT g.*, t.token, coalesce(h.cnt, 0) AS hc, coalesce(a.cnt, 0) AS ac
         FROM (SELECT DISTINCT {on}Generator FROM freq WHERE Generator <> 'human') g
         JOIN (SELECT DISTINCT {on}token FROM freq) t {f"ON t.{by} = g.{by}" if by else "ON TRUE"}
         LEFT JOIN freq h ON h.Generator = 'human' AND h.token = t.token {f"AND h.{by} = g.{by}" if by else ""}
         LEFT JOIN freq a ON a.Generator = g.Generator AND a.token = t.token {f"AND a.{by} = g.{by}" if by else ""}
         WHERE h.cnt IS NOT NULL OR a.cnt IS NOT NULL)) WHERE hsum > 0 AND asum > 0"""


_H = "(y - x) / sqrt(2e0) * sqrt(x * x + y * y)"


@query("token_compare", sql("samples", ("freq", _FREQ), ("cmp", _compare()), select=f"""SELECT Generator, token, {sql6('x')} AS human_share,
       {sql6('y')} AS ai_share, {sql6(_H)} AS heuristic FROM cmp"""))
def token_compare(spark, folder):
    rows = fq.compare_tokens(_frequencies(spark, folder))
    return rows.select("Generator", "token", *[r6(c).alias(c) for c in ("human_share", "ai_share", "heuristic")])


def _top_sql(freq, by=""):
    on = f"{by}, " if by else ""
    return sql("samples", ("freq", freq), ("cmp", _compare(by)), ("scored", f"SELECT *, round({_H}, 12) AS h FROM cmp"),
               ("top", f"SELECT *, CAST(row_number() OVER (PARTITION BY {on}Generator ORDER BY abs(h) DESC, token) AS INTEGER) AS place FROM scored"),
               select=f"SELECT {on}Generator, token, place, {sql6('h')} AS heuristic, CASE WHEN h < 0 THEN 'human' ELSE 'ai' END AS class FROM top WHERE place <= 15")


def _top(compared, by=()):
    # Rounding makes ties of equal shares exact before they are broken by token.
    rounded = compared.withColumn("heuristic", F.round("heuristic", 12))
    rows = fq.top_tokens(rounded, by)
    return rows.select(*by, "Generator", "token", "place", r6("heuristic").alias("heuristic"), "class")


@query("token_top15", _top_sql(_FREQ))
def token_top15(spark, folder):
    return _top(fq.compare_tokens(_frequencies(spark, folder)))


@query("token_top15_by_dataset", _top_sql(_FREQ_SET, "Dataset"))
def token_top15_by_dataset(spark, folder):
    return _top(fq.compare_tokens(_frequencies(spark, folder, ("Dataset", "Generator")), ("Dataset",)), ("Dataset",))


@query("token_top15_python", _top_sql(_FREQ.replace(f"WHERE {_SETTING}", f"WHERE {_SETTING} AND Language = 'python'")))
def token_top15_python(spark, folder):
    rows = flt.languages(["python"])(samples(spark, folder).filter(default_setting()))
    return _top(fq.compare_tokens(fq.token_frequencies(rows)))


def _sentences(text):
    """A user's tokenizer: any function from a column to an array of strings."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda part: F.trim(part)), lambda part: part != "")


@query("token_frequency_own_tokenizer", r"""SELECT lang AS Generator, token, count(*) AS cnt FROM
    (SELECT lang, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda p: trim(p, ' ')), lambda p: p <> '')) AS token FROM documents)
    GROUP BY ALL""")
def token_frequency_own_tokenizer(spark, folder):
    """Sentences counted as tokens."""
    docs = table(spark, folder, "documents").select(F.col("lang").alias("Generator"), F.col("text").alias("Code"))
    return fq.token_frequencies(docs, tokenizer=_sentences)


@query("token_id_round_trip", rf"""SELECT item_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS text FROM (SELECT item_id, text FROM benchmark
    UNION ALL SELECT -1 - item_id, repeat(' ', (item_id % 3)::INTEGER) FROM benchmark)""")
def token_id_round_trip(spark, folder):
    """Texts, blank ones among them, to vocabulary numbers and back."""
    texts = table(spark, folder, "benchmark").select("item_id", "text")
    blank = texts.select((-1 - F.col("item_id")).alias("item_id"), F.repeat(F.lit(" "), (F.col("item_id") % 3).cast("int")).alias("text"))
    texts = texts.unionByName(blank)
    tokens = texts.select(F.explode(words(F.col("text"))).alias("token"))
    vocab = materialize(vocabulary(tokens), "vocabulary")
    return decode_ids(encode_ids(texts, vocab, "item_id", words, "text"), vocab, "item_id")


@query("order_restoration", sql("samples", ("sized", f"SELECT sample_id, len({_WORDS}) AS length FROM samples"),
       select="SELECT sample_id, CAST(length AS INTEGER) AS length, row_number() OVER (ORDER BY sample_id) - 1 AS index FROM sized"))
def order_restoration(spark, folder):
    """Rows worked on by size group come back in input order."""
    grouped = gp.size_groups(_sized(spark, folder), "length", 0.25)
    # By range, so that a size group with most of the rows fills many tasks.
    batched = grouped.repartitionByRange("size_group", "length", "sample_id")
    return gp.running_index(batched.drop("size_group"), [F.col("sample_id")])
