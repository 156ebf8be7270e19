"""Generation jobs and streams over samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.languages import DISPLAY_NAMES
from ..functions.scores import seeded_uniform
from ..functions.text import sample_row_hash
from ..operators import generation as gen
from ..operators import ngram
from ..operators import setops as so
from ..plans import sketch
from ..plans.storage import COMPACT, SLICES, empty_folder, materialize, parts_for, scratch_path, slices
from ..schemas import HUMAN, SAMPLE_SCHEMA
from ..sources.bucketed import BucketedStore
from ..streaming import ingest
from .detection_queries import MODELS, RUN_TIME, _BASE, corpus
from .registry import query, r6, sql6
from .sample_queries import prompt_sql
from .views import SAMPLE_HASH, samples, sql, table, detections

_MAX_TOKENS = 1024
_FORMATS = {"en": "doc_comment", "fr": "named_language_comment", "de": "instruction", "es": "language_comment"}
# One of the models supports a single language.
# Models that take instructions fence their code; what the others write is kept as it is.
_REGISTRY = [
    (m, name, _FORMATS[m], _MAX_TOKENS, _FORMATS[m] == "instruction") for m in MODELS for name in DISPLAY_NAMES if m != "es" or name == "python"
]
_REGISTRY_SQL = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in _REGISTRY) + ") r(model, Language, prompt_format, max_tokens, clean)"


def _registry(spark):
    return spark.createDataFrame(_REGISTRY, "model string, Language string, prompt_format string, max_tokens int, clean boolean")


def _counts(spark, folder):
    return ngram.train(ngram.bigram_counts(corpus(spark, folder), ["sample_id", "model"]), MODELS).counts


_GREEDY = "SELECT model, ctx, token FROM counts QUALIFY row_number() OVER (PARTITION BY model, ctx ORDER BY c DESC, token) = 1"
_PROMPTS = prompt_sql("Prompt")
_OPEN = """SELECT *, right(full_prompt, 1) AS last, greatest(1, least(max_tokens - length(full_prompt), greatest(floor(length(Code) * 1.25e0), 256)))::INTEGER AS budget FROM
    (SELECT s.*, r.model, r.max_tokens, CASE r.prompt_format """ + " ".join(
    f"WHEN '{name}' THEN {text.replace('Language', 's.Language').replace('Prompt', 's.Prompt')}" for name, text in _PROMPTS.items()
) + " END AS full_prompt FROM samples s JOIN registry r ON s.Language = r.Language WHERE s.Generator = 'human')"
_WALK = """SELECT model, last AS ctx, 0 AS k, last, '' AS txt FROM (SELECT DISTINCT model, last FROM open_rows)
    UNION ALL SELECT w.model, w.ctx, k + 1, g.token, txt || g.token FROM walk w JOIN greedy g ON g.model = w.model AND g.ctx = w.last WHERE k < 1024"""
_GEN = _BASE[:2] + (("greedy", _GREEDY), ("registry", _REGISTRY_SQL), ("open_rows", _OPEN), ("walk(model, ctx, k, last, txt)", _WALK),
       ("ends", "SELECT model, ctx, max(k) AS kmax FROM walk GROUP BY ALL"))
_REST = "TopK, TopP, Temperature, Prompt, OriginalPrompt"


@query("generation_job", sql("samples", *_GEN, select=f"""
    SELECT o.sample_id, o.model AS Generator, Language, w.txt AS Code, {_REST}, CAST({RUN_TIME} AS BIGINT) AS Date, Dataset,
      CAST(list_position(['human', 'en', 'fr', 'de', 'es'], o.model) - 1 AS BIGINT) AS gen_ord
    FROM open_rows o JOIN ends e ON e.model = o.model AND e.ctx = o.last JOIN walk w ON w.model = o.model AND w.ctx = o.last AND w.k = least(o.budget, e.kmax)
    UNION ALL SELECT sample_id, Generator, Language, Code, {_REST}, Date, Dataset, 0 FROM samples WHERE Generator = 'human'"""))
def generation_job(spark, folder):
    """Human samples and what four models continue from their prompts, interlaced."""
    human = samples(spark, folder).filter(F.col("Generator") == HUMAN)
    made = gen.generate(human, _registry(spark), _counts(spark, folder), RUN_TIME)
    return so.interlace(human.select(*made.columns).unionByName(made), "sample_id", MODELS)


_SHAPE = """SELECT model, ctx, token, w / sum(w) OVER (PARTITION BY model, ctx) AS p FROM
    (SELECT *, sum(w) OVER (PARTITION BY model, ctx ORDER BY w DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(w) OVER (PARTITION BY model, ctx) AS reached FROM
      (SELECT *, row_number() OVER (PARTITION BY model, ctx ORDER BY w DESC, token) AS place FROM
        (SELECT model, ctx, token, pow(c / (sum(c) OVER (PARTITION BY model, ctx))::DOUBLE, 1e0 / 0.97e0) AS w FROM counts)) WHERE place <= 50)
    WHERE coalesce(reached, 0e0) < 0.95e0 - 1e-9"""
# Every slot keeps its token up to a whole part of 2 ** 32 and holds one other token beyond. Lights are at their
# deficits before them, heavies at their excesses with them; a slot's other token is the next heavy.
_ALIAS = """SELECT model, ctx, n, slot, token, CASE WHEN alone THEN token ELSE other END AS other,
      CASE WHEN alone THEN 4294967296 ELSE (rest * 4294967296) // W END AS keep FROM
    (SELECT *, rest >= W OR other IS NULL AS alone FROM
      (SELECT *, CASE WHEN light THEN W - gap ELSE W + upto - greatest(coalesce(deficit, 0), upto) END AS rest FROM
        (SELECT *, first_value(CASE WHEN NOT light THEN token END IGNORE NULLS) OVER (PARTITION BY model, ctx ORDER BY spot, light, token
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS other,
            last_value(CASE WHEN light THEN upto END IGNORE NULLS) OVER (PARTITION BY model, ctx ORDER BY spot, light, token
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deficit FROM
          (SELECT *, CASE WHEN light THEN upto - gap ELSE upto END AS spot FROM
            (SELECT *, (sum(gap) OVER (PARTITION BY model, ctx, light ORDER BY token))::BIGINT AS upto FROM
              (SELECT *, n * parts <= W AS light, abs(n * parts - W) AS gap FROM
                (SELECT model, ctx, token, parts, count(*) OVER (PARTITION BY model, ctx) AS n, (sum(parts) OVER (PARTITION BY model, ctx))::BIGINT AS W,
                    row_number() OVER (PARTITION BY model, ctx ORDER BY token) - 1 AS slot FROM
                  (SELECT model, ctx, token, greatest(1, round(p * 268435456e0))::BIGINT AS parts FROM shape))))))))"""


def _shape(spark, folder):
    return gen.sampling_shape(_counts(spark, folder), temperature=0.97, top_k=50, top_p=0.95)


@query("sampling_shape", sql(*_BASE[:2], ("shape", _SHAPE), select=f"SELECT model, ctx, token, {sql6('p')} AS p FROM shape"))
def sampling_shape(spark, folder):
    return _shape(spark, folder).select("model", "ctx", "token", r6("p").alias("p"))


@query("alias_tables", sql(*_BASE[:2], ("shape", _SHAPE), ("alias", _ALIAS), select="""SELECT model, ctx, slot, token, other, keep, n AS size,
    (SELECT count(*) FROM shape s WHERE s.model = a.model AND s.ctx = a.token) AS token_size FROM alias a"""))
def alias_tables(spark, folder):
    """Slots from which a token is drawn in constant time."""
    slots = gen.alias_tables(_shape(spark, folder))
    return slots.select("model", "ctx", F.col("slot").cast("bigint").alias("slot"), "token", "other", "keep", "size",
                        F.coalesce("token_size", F.lit(0)).alias("token_size"))


_CANDIDATES = 3
_BITS = "('0x' || substr(sha256('81053|' || sample_id || '|' || model || '|' || candidate || '|' || k), 1, 8))::BIGINT"
_DRAW = f"""SELECT sample_id, model, candidate, budget, 0 AS k, last, {_BITS.replace("|| k)", "|| 0)")} AS x FROM open_rows, (SELECT unnest(range({_CANDIDATES})) AS candidate)
    UNION ALL SELECT d.sample_id, d.model, d.candidate, d.budget, d.k + 1, CASE WHEN (d.x * a.n) & 4294967295 < a.keep THEN a.token ELSE a.other END,
      {_BITS.replace("sample_id", "d.sample_id").replace("model", "d.model").replace("candidate", "d.candidate").replace("|| k)", "|| (d.k + 1))")}
      FROM draw d JOIN sizes z ON z.model = d.model AND z.ctx = d.last JOIN alias a ON a.model = d.model AND a.ctx = d.last AND a.slot = (d.x * z.n) >> 32
      WHERE d.k < d.budget"""
_SAMPLED = _BASE[:2] + (("shape", _SHAPE), ("alias", _ALIAS), ("sizes", "SELECT model, ctx, count(*) AS n FROM shape GROUP BY ALL"),
           ("registry", _REGISTRY_SQL), ("open_rows", _OPEN), ("draw(sample_id, model, candidate, budget, k, last, x)", _DRAW),
           ("ended", "SELECT sample_id, model, candidate, coalesce(string_agg(last, '' ORDER BY k) FILTER (k > 0), '') AS output FROM draw GROUP BY ALL"))


def _candidates(spark, folder):
    """Three continuations per prompt and model, as long as their budgets, reproducible by their keys."""
    human = samples(spark, folder).filter(F.col("Generator") == HUMAN)
    rows = gen.open_prompts(human, _registry(spark))
    slots = F.sequence(F.lit(0), F.lit(_CANDIDATES - 1))
    rows = rows.select("sample_id", "model", "last", "budget", F.explode(slots).alias("candidate"))
    done = gen.continue_sampled(rows, _shape(spark, folder), ["sample_id", "model", "candidate"])
    return done.select("sample_id", "model", "candidate", F.array_join("tokens", "").alias("output"))


@query("generation_sampled", sql("samples", *_SAMPLED, select="SELECT sample_id, model, candidate::INTEGER AS candidate, output FROM ended"))
def generation_sampled(spark, folder):
    return _candidates(spark, folder)


@query("best_of_n", sql("samples", *_SAMPLED, select="""SELECT sample_id, model, output FROM ended QUALIFY row_number() OVER
    (PARTITION BY sample_id, model ORDER BY len(list_distinct(string_split(output, ''))) DESC, candidate) = 1"""))
def best_of_n(spark, folder):
    """The candidate with the most distinct characters."""
    score = F.size(F.array_distinct(F.split("output", "")))
    return gen.best_of(_candidates(spark, folder), ["sample_id", "model"], score)


_RUN = {"temperature": 0.97, "top_k": 50, "top_p": 0.95}
_MADE = f"""o.Language, output AS Code, 50 AS TopK, 0.95e0 AS TopP, 0.97e0 AS Temperature, o.Prompt, o.OriginalPrompt,
    CAST({RUN_TIME} AS BIGINT) AS Date, o.Dataset"""


@query("generation_job_sampled", sql("samples", *_SAMPLED, select=f"""SELECT sample_id, candidate::INTEGER AS slot, model AS Generator, {_MADE}
    FROM ended JOIN open_rows o USING (sample_id, model)"""))
def generation_job_sampled(spark, folder):
    """Three sampled outputs per prompt and model under one setting, as sample rows."""
    human = samples(spark, folder).filter(F.col("Generator") == HUMAN)
    return gen.generate_sampled(human, _registry(spark), _counts(spark, folder), RUN_TIME, [_RUN], count=_CANDIDATES)


@query("generation_job_best_of", sql("samples", *_SAMPLED, ("best", """SELECT sample_id, model, output FROM ended QUALIFY row_number() OVER
    (PARTITION BY sample_id, model ORDER BY len(list_distinct(string_split(output, ''))) DESC, candidate) = 1"""),
    select=f"SELECT sample_id, 0 AS slot, model AS Generator, {_MADE} FROM best JOIN open_rows o USING (sample_id, model)"))
def generation_job_best_of(spark, folder):
    """One output per prompt and model: of three candidates that with the most distinct characters."""
    human = samples(spark, folder).filter(F.col("Generator") == HUMAN)
    score = F.size(F.array_distinct(F.split("output", "")))
    return gen.generate_sampled(
        human, _registry(spark), _counts(spark, folder), RUN_TIME, [_RUN], best_of_n=_CANDIDATES, score=score
    )


_GRID = [{"GridTemperature": t, "GridTopP": p} for t in (0.2, 0.97) for p in (0.5, 0.95)]


@query("settings_grid", "SELECT doc_id, t AS GridTemperature, p AS GridTopP FROM documents, (VALUES " + ", ".join(
       f"({g['GridTemperature']}e0, {g['GridTopP']}e0)" for g in _GRID) + ") g(t, p)")
def settings_grid(spark, folder):
    return gen.settings_grid(table(spark, folder, "documents").select("doc_id"), _GRID)


@query("seeded_rows", """SELECT doc_id, slot, ('0x' || substr(sha256('81053|' || doc_id || '|' || slot), 1, 8))::BIGINT / 4294967296e0 AS u
    FROM documents, (SELECT CAST(unnest(range(3)) AS INTEGER) AS slot)""")
def seeded_rows(spark, folder):
    """Random numbers that depend on the row's keys, not on its partition."""
    docs = table(spark, folder, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    return docs.withColumn("u", seeded_uniform(gen.SEED, F.col("doc_id"), F.col("slot")))


# ------------------------------------------------------------------- streams


def _arrived(rows, store, least):
    """Append rows to a store that a stream reads: no more files than are returned, ``least`` or a multiple, and none larger than the parts of the input."""
    files = parts_for(rows, least)
    if rows.rdd.getNumPartitions() < least:
        rows = rows.repartition(files)
    rows.write.mode("append").option("compression", COMPACT).parquet(store)
    return files


def _prepared(rows):
    return rows.withColumn("CodeSampleHash", sample_row_hash()).filter(F.col("Language") != "generic")


@query("stream_ingest", sql("samples", select=f"SELECT {', '.join(SAMPLE_SCHEMA.names)}, {SAMPLE_HASH} AS CodeSampleHash FROM samples WHERE Language <> 'generic'"))
def stream_ingest(spark, folder):
    """Two runs over a growing store; the second goes on where the first ended."""
    store, target, position = (scratch_path(spark, x) for x in ("store", "target", "position"))
    rows = samples(spark, folder).drop("sample_id")
    for part in ("Generator = 'human'", "Generator <> 'human'"):
        files = _arrived(rows.filter(part), store, 4)
        ingest.ingest(ingest.read_stream(spark, store, files_per_batch=2 * files), _prepared, target, position).awaitTermination()
    return spark.read.parquet(target)


@query("stream_dedupe", sql("samples", select=f"SELECT DISTINCT {SAMPLE_HASH} AS hash FROM samples"))
def stream_dedupe(spark, folder):
    """Every sample arrives twice and is kept once."""
    store, target, position = (scratch_path(spark, x) for x in ("store", "target", "position"))
    for part in slices(samples(spark, folder), F.col("sample_id")):
        rows = part.drop("sample_id")
        files = _arrived(rows.unionByName(rows), store, 4)
        stream = ingest.read_stream(spark, store, files_per_batch=files // 2)
        ingest.append_unique(stream, target, position).awaitTermination()
        empty_folder(store)  # what has been read
    return spark.read.parquet(target).select("hash")


@query("stream_dedupe_two_runs", sql("samples", select=f"SELECT DISTINCT {SAMPLE_HASH} AS hash FROM samples"))
def stream_dedupe_two_runs(spark, folder):
    """Half of the samples, then all of them from a new checkpoint, into one store."""
    target, rows = scratch_path(spark, "target"), samples(spark, folder)
    for part, most in (("sample_id % 2 = 0", SLICES // 2), ("true", SLICES)):
        store, position = scratch_path(spark, "store"), scratch_path(spark, "position")
        for arriving in slices(rows.filter(part), F.col("sample_id"), most):
            files = _arrived(arriving.drop("sample_id"), store, 2)
            stream = ingest.read_stream(spark, store, files_per_batch=files)
            ingest.append_unique(stream, target, position).awaitTermination()
            empty_folder(store)  # what has been read
    return spark.read.parquet(target).select("hash")


@query("stream_unique_in_time", sql("samples", select=f"SELECT DISTINCT {SAMPLE_HASH} AS hash FROM samples"))
def stream_unique_in_time(spark, folder):
    """Every sample arrives twice; the second arrival is known by state that the watermark bounds."""
    store, target, position = (scratch_path(spark, x) for x in ("store", "target", "position"))
    rows = samples(spark, folder).drop("sample_id")
    files = _arrived(rows.unionByName(rows), store, 4)
    dated = ingest.read_stream(spark, store, files_per_batch=files // 2).withColumn("at", F.timestamp_seconds("Date"))
    first = lambda stream: ingest.unique_samples(stream, ("at", "36500 days")).select("hash")
    ingest.ingest(dated, first, target, position).awaitTermination()
    return spark.read.parquet(target)


@query("stream_scores", sql("samples", select="SELECT sample_id, length(Code) AS Value FROM samples"))
def stream_scores(spark, folder):
    """Scores appended per micro-batch, each batch once however often it runs."""
    store, target, position = (scratch_path(spark, x) for x in ("store", "target", "position"))
    rows = samples(spark, folder).select("sample_id", "Code")
    files = _arrived(rows, store, 4)
    score = lambda batch: batch.select("sample_id", F.length("Code").cast("bigint").alias("Value"))
    for where in (position, scratch_path(spark, "position")):  # all again after the first position is lost
        stream = ingest.read_stream(spark, store, rows.schema, files // 2)
        ingest.score_stream(stream, score, target, where, ["sample_id"]).awaitTermination()
    return spark.read.parquet(target).select("sample_id", "Value")


@query("resume_antijoin", sql("samples", select=f"""SELECT sample_id FROM samples WHERE {SAMPLE_HASH} NOT IN
    (SELECT {SAMPLE_HASH} FROM samples JOIN labels ON doc_id = sample_id)"""))
def resume_antijoin(spark, folder):
    """Samples left to process when the labelled ones are done."""
    rows = samples(spark, folder)
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id"))
    done = rows.join(labelled, "sample_id", "left_semi").select(sample_row_hash().alias("CodeSampleHash"))
    return ingest.remaining(rows, done).select("sample_id")


@query("resume_with_sketch", sql("samples", select=f"""SELECT sample_id FROM samples WHERE {SAMPLE_HASH} NOT IN
    (SELECT {SAMPLE_HASH} FROM samples JOIN labels ON doc_id = sample_id)"""))
def resume_with_sketch(spark, folder):
    """As resume_antijoin, with a sketch in two pieces beside the list of what is done."""
    rows, path = samples(spark, folder), scratch_path(spark, "sketch")
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id"))
    done = materialize(rows.join(labelled, "sample_id", "left_semi").select(sample_row_hash().alias("CodeSampleHash")), "done")
    blocks = sketch.blocks_for(done.count())
    for digits in ("CodeSampleHash < '8'", "CodeSampleHash >= '8'"):
        sketch.write_sketch(done.where(digits), "CodeSampleHash", path, blocks)
    return ingest.remaining(rows, done, sketch=sketch.read_sketch(spark, path)).select("sample_id")


@query("resume_bucketed", sql("samples", select=f"""SELECT sample_id FROM samples WHERE {SAMPLE_HASH} NOT IN
    (SELECT {SAMPLE_HASH} FROM samples JOIN labels ON doc_id = sample_id)"""))
def resume_bucketed(spark, folder):
    """As resume_antijoin, against a store in buckets by the hash."""
    path = scratch_path(spark, "bucketed")
    store = BucketedStore(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, "CodeSampleHash", 8)
    rows = samples(spark, folder).withColumn("CodeSampleHash", sample_row_hash())
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id"))
    for _ in range(2):  # what is stored already is not stored again
        store.add_missing(rows.join(labelled, "sample_id", "left_semi"))
    return store.missing(rows).select("sample_id")


@query("resume_scores", sql("samples", "detections", select="""SELECT sample_id, Detector, BaseModel, SecondaryModel FROM detections
    WHERE NOT (Detector = 'rank' OR (Detector = 'binoculars' AND BaseModel = 'gen-a'))"""))
def resume_scores(spark, folder):
    """Detection rows whose key is not stored yet."""
    rows = detections(spark, folder).withColumn("CodeSampleHash", F.sha2(F.col("sample_id").cast("string"), 256))
    store = rows.filter((F.col("Detector") == "rank") | ((F.col("Detector") == "binoculars") & (F.col("BaseModel") == "gen-a")))
    return ingest.not_yet_scored(rows, store).select("sample_id", "Detector", "BaseModel", "SecondaryModel")
