"""Detector scores from bigram models and from given logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import detectors as det
from ..operators import ngram
from .registry import query, r6, sql6
from .views import SAMPLE_HASH, samples, sql, table

MODELS = ("en", "fr", "de", "es")
PAIRS = (("en", "fr"), ("fr", "en"), ("de", "de"))
RUN_TIME = 1735689600


def corpus(spark, folder):
    """Every document trains the model of its language and is scored by all."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("model"), F.col("text").alias("Code"))


def _statistics(spark, folder, pairs=(), single=True):
    counted = ngram.bigram_counts(corpus(spark, folder), ["sample_id", "model"])
    models = ngram.train(counted, MODELS)
    return ngram.token_statistics(counted, models, pairs=pairs, single=single)


def _scores(spark, folder, *names, extra=None):
    chosen = {**det.detectors(), **(extra or {})}
    chosen = {n: chosen[n] for n in names or det.detectors()}
    needs = [d.needs_pair for d in chosen.values()]
    stats = _statistics(spark, folder, PAIRS if any(needs) else (), not all(needs))
    return det.score(stats, chosen)


# The same by brute force: every token of every text, every model or pair, and
# for pairs the sum over the whole vocabulary.
_CHARS = """SELECT doc_id AS sample_id, lang, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, pos
    FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents)"""
_COUNTS = "SELECT lang AS model, ctx, token, count(*) AS c FROM chars WHERE ctx IS NOT NULL GROUP BY ALL"
_VOCAB = "SELECT DISTINCT token FROM chars"
_DENSE = """SELECT g.model, g.ctx, g.token, coalesce(c.c, 0) AS c,
      (coalesce(c.c, 0) + 1) / (sum(coalesce(c.c, 0)) OVER w + count(*) OVER w)::DOUBLE AS p,
      rank() OVER (PARTITION BY g.model, g.ctx ORDER BY coalesce(c.c, 0) DESC) AS rank
    FROM (SELECT m.model, x.ctx, v.token FROM (SELECT DISTINCT model FROM counts) m,
          (SELECT DISTINCT ctx FROM counts) x, vocab v) g
    LEFT JOIN counts c ON c.model = g.model AND c.ctx = g.ctx AND c.token = g.token
    WINDOW w AS (PARTITION BY g.model, g.ctx)"""
_CONTEXT = "SELECT model, ctx, -sum(p * ln(p)) AS entropy FROM dense GROUP BY ALL"
_SEEN = """SELECT sample_id, ctx, token, count(*) AS n FROM chars WHERE ctx IS NOT NULL GROUP BY ALL"""
_SINGLE = """SELECT sample_id, d.model, sum(n * ln(d.p)) / sum(n) AS loglikelihood,
      sum(n * e.entropy) / sum(n) AS entropy, sum(n * d.rank) / sum(n)::DOUBLE AS rank
    FROM seen s JOIN dense d ON d.ctx = s.ctx AND d.token = s.token
    JOIN context e ON e.model = d.model AND e.ctx = s.ctx GROUP BY ALL"""
_PAIRS = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") p(model, model2)"
_CROSS = """SELECT p.model, p.model2, a.ctx, sum(b.p * ln(a.p)) AS mu,
      greatest(sum(b.p * ln(a.p) * ln(a.p)) - sum(b.p * ln(a.p)) * sum(b.p * ln(a.p)), 0e0) AS var
    FROM pairs p JOIN dense a ON a.model = p.model JOIN dense b ON b.model = p.model2 AND b.ctx = a.ctx AND b.token = a.token
    GROUP BY ALL"""
_DOUBLE = """SELECT sample_id, x.model, x.model2, sum(n * ln(d.p)) AS lp, sum(n * x.mu) AS mu, sum(n * x.var) AS var, sum(n) AS n
    FROM seen s JOIN cross_stats x ON x.ctx = s.ctx JOIN dense d ON d.model = x.model AND d.ctx = s.ctx AND d.token = s.token
    GROUP BY ALL"""
_BASE = (("chars", _CHARS), ("counts", _COUNTS), ("vocab", _VOCAB), ("dense", _DENSE), ("context", _CONTEXT), ("seen", _SEEN))
_BOTH = _BASE + (("single", _SINGLE), ("pairs", _PAIRS), ("cross_stats", _CROSS), ("double", _DOUBLE))
# Documents of fewer than two characters have no scored token.
_SHORT = "SELECT doc_id AS sample_id, m.model FROM documents, (SELECT unnest(['en', 'fr', 'de', 'es']) AS model) m WHERE length(text) < 2"


def _single_sql(name):
    return sql(*_BASE, ("single", _SINGLE), ("short", _SHORT), select=f"""
      SELECT sample_id, model AS BaseModel, {sql6(name)} AS Value FROM single
      UNION ALL SELECT sample_id, model, NULL FROM short""")


_DISCREPANCY = "(lp - mu) / sqrt(var)"
_RATIO = "lp / mu"


def _pair_sql(expression):
    return sql(*_BOTH, ("short", _SHORT), select=f"""
      SELECT sample_id, model AS BaseModel, model2 AS SecondaryModel, {sql6(expression)} AS Value FROM double
      UNION ALL SELECT sample_id, pairs.model, pairs.model2, NULL FROM short JOIN pairs USING (model)""")


def _single(spark, folder, name):
    return _scores(spark, folder, name).select("sample_id", "BaseModel", r6("Value").alias("Value"))


def _pair(spark, folder, name, extra=None):
    rows = _scores(spark, folder, name, extra=extra)
    return rows.select("sample_id", "BaseModel", "SecondaryModel", r6("Value").alias("Value"))


@query("detector_loglikelihood", _single_sql("loglikelihood"))
def detector_loglikelihood(spark, folder):
    return _single(spark, folder, "loglikelihood")


@query("detector_entropy", _single_sql("entropy"))
def detector_entropy(spark, folder):
    return _single(spark, folder, "entropy")


@query("detector_rank", _single_sql("rank"))
def detector_rank(spark, folder):
    return _single(spark, folder, "rank")


@query("detector_discrepancy", _pair_sql(_DISCREPANCY))
def detector_discrepancy(spark, folder):
    return _pair(spark, folder, "fastdetectgpt")


@query("detector_binoculars", _pair_sql(_RATIO))
def detector_binoculars(spark, folder):
    return _pair(spark, folder, "binoculars")


_MEDIAN = """SELECT sample_id, model, model2, sum(lp) / count(*) AS lp, median(xent) AS med FROM
      (SELECT s.sample_id, x.model, x.model2, ln(d.p) AS lp, -x.mu AS xent FROM chars s JOIN cross_stats x ON x.ctx = s.ctx
       JOIN dense d ON d.model = x.model AND d.ctx = s.ctx AND d.token = s.token) GROUP BY ALL"""


@query("detector_binoculars_median", sql(*_BOTH, ("short", _SHORT), ("med", _MEDIAN), select=f"""
      SELECT sample_id, model AS BaseModel, model2 AS SecondaryModel, {sql6('-lp / med')} AS Value FROM med
      UNION ALL SELECT sample_id, pairs.model, pairs.model2, NULL FROM short JOIN pairs USING (model)"""))
def detector_binoculars_median(spark, folder):
    median = det.Detector(det.perplexity_ratio_median(), needs_pair=True)
    return _pair(spark, folder, "median", extra={"median": median})


_ALL = f"""
      SELECT sample_id, model AS BaseModel, NULL AS SecondaryModel, unnest(['loglikelihood', 'entropy', 'rank']) AS Detector,
        unnest([{sql6('loglikelihood')}, {sql6('entropy')}, {sql6('rank')}]) AS Value FROM single
      UNION ALL SELECT sample_id, model, model2, unnest(['fastdetectgpt', 'binoculars']), unnest([{sql6(_DISCREPANCY)}, {sql6(_RATIO)}]) FROM double
      UNION ALL SELECT sample_id, model, NULL, unnest(['loglikelihood', 'entropy', 'rank']), NULL FROM short
      UNION ALL SELECT sample_id, pairs.model, pairs.model2, unnest(['fastdetectgpt', 'binoculars']), NULL FROM short JOIN pairs USING (model)"""


@query("detections_all", sql(*_BOTH, ("short", _SHORT), select=_ALL))
def detections_all(spark, folder):
    """Five detectors for every document, model and registered pair in one pass."""
    return _scores(spark, folder).withColumn("Value", r6("Value"))


@query("detection_coverage", sql(*_BOTH, ("short", _SHORT), ("scores", _ALL),
       ("wanted", """SELECT unnest(['loglikelihood', 'entropy', 'rank', 'fastdetectgpt', 'binoculars']) AS Detector, m.model AS BaseModel
        FROM (SELECT unnest(['en', 'fr', 'de', 'es']) AS model) m"""),
       select="""SELECT w.Detector, w.BaseModel, (w.Detector IN ('loglikelihood', 'entropy', 'rank') OR w.BaseModel <> 'es') AS registered,
       count(s.sample_id) AS rows FROM wanted w LEFT JOIN scores s ON s.Detector = w.Detector AND s.BaseModel = w.BaseModel GROUP BY ALL"""))
def detection_coverage(spark, folder):
    return det.coverage(MODELS, PAIRS, _scores(spark, folder))


@query("to_detection", sql("samples", *_BASE, ("single", _SINGLE), ("short", _SHORT),
       ("scores", "SELECT sample_id, model, loglikelihood FROM single UNION ALL SELECT sample_id, model, NULL FROM short"),
       select=f"""SELECT sample_id, sha256(OriginalPrompt) AS PromptHash,
       {SAMPLE_HASH} AS CodeSampleHash,
       Language, {sql6('loglikelihood')} AS Value, CAST(512 AS INTEGER) AS MaxLength, 'loglikelihood' AS Detector, Generator, model AS BaseModel,
       CAST(NULL AS VARCHAR) AS SecondaryModel, Code, TopK, TopP, Temperature, CAST({RUN_TIME} AS BIGINT) AS Date, Dataset
       FROM samples JOIN scores USING (sample_id)"""))
def to_detection(spark, folder):
    """Full detection rows, the run's length limit recorded on each."""
    scores = _scores(spark, folder, "loglikelihood")
    return det.to_detections(samples(spark, folder), scores, RUN_TIME, 512).withColumn("Value", r6("Value"))


# ------------------------------------------------------------ given logits


def _logits(spark, folder):
    """Each vector as the logits of one position, its label as the true token."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.lit("m").alias("model"), F.col("embedding").alias("logits"),
        F.col("label"), F.lit(False).alias("label_pad"),
    )


_LONG = """SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS tok FROM embeddings"""
_SOFT = """SELECT vec_id, label, tok, x, x - max(x) OVER w - ln(sum(exp(x - m)) OVER w) AS lp FROM
    (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM long) WINDOW w AS (PARTITION BY vec_id)"""


@query("prob_softmax_stats", sql(("long", _LONG), ("soft", _SOFT), select=f"""
      SELECT s.vec_id AS sample_id, {sql6('max(CASE WHEN s.tok = s.label THEN s.lp END)')} AS logprob,
        {sql6('-sum(exp(s.lp) * s.lp)')} AS entropy,
        (1 + count(*) FILTER (s.x > o.x))::DOUBLE AS rank
      FROM soft s JOIN soft o ON o.vec_id = s.vec_id AND o.tok = o.label GROUP BY s.vec_id"""))
def prob_softmax_stats(spark, folder):
    stats = det.statistics_from_logits(_logits(spark, folder))
    return stats.select("sample_id", r6("logprob").alias("logprob"), r6("entropy").alias("entropy"), "rank")


@query("prob_pair_stats", sql(("long", _LONG), ("soft", _SOFT), select=f"""
      SELECT a.vec_id AS sample_id, {sql6('max(CASE WHEN a.tok = a.label THEN a.lp END)')} AS logprob,
        {sql6('sum(exp(b.lp) * a.lp)')} AS mu,
        {sql6('greatest(sum(exp(b.lp) * a.lp * a.lp) - sum(exp(b.lp) * a.lp) * sum(exp(b.lp) * a.lp), 0e0)')} AS var,
        {sql6('-sum(exp(b.lp) * a.lp)')} AS xent
      FROM (SELECT *, CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN 0 ELSE vec_id + 1 END AS after FROM soft) a
      JOIN soft b ON b.vec_id = a.after AND b.tok = a.tok GROUP BY a.vec_id"""))
def prob_pair_stats(spark, folder):
    """Each vector as the base model, the next one (for the last the first) as the second model."""
    base = _logits(spark, folder)
    last = base.agg(F.max("sample_id").alias("last"))
    before = F.when(F.col("sample_id") == 0, F.col("last")).otherwise(F.col("sample_id") - 1)
    second = base.crossJoin(F.broadcast(last)).select(
        before.alias("sample_id"), F.lit("m2").alias("model"), "logits",
        F.lit(None).cast("int").alias("label"), "label_pad",
    )
    # Both models must name the same true token, so the second takes the base's.
    second = second.drop("label").join(base.select("sample_id", "label"), "sample_id").select(*base.columns)
    shifted = base.unionByName(second).withColumn("pos", F.lit(0))
    pairs = spark.createDataFrame([("m", "m2")], "model string, model2 string")
    stats = det.pair_statistics_from_logits(shifted, pairs)
    return stats.select("sample_id", *[r6(c).alias(c) for c in ("logprob", "mu", "var", "xent")])


@query("pair_mismatch", """SELECT vec_id AS sample_id, CASE WHEN vec_id % 5 = 0 THEN 'first model only' WHEN vec_id % 7 = 0 THEN 'second model only'
      ELSE 'different token or padding' END AS reason FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0 OR vec_id % 11 = 0""")
def pair_mismatch(spark, folder):
    """Positions that one model lacks, or has with another token, are named and not lost."""
    base, number = _logits(spark, folder).withColumn("pos", F.lit(0)), F.col("sample_id")
    other = F.when(number % 11 == 0, F.col("label") + 1).otherwise(F.col("label"))
    second = base.withColumn("model", F.lit("m2")).withColumn("label", other).filter(number % 5 != 0)
    first = base.filter((number % 7 != 0) | (number % 5 == 0))
    pairs = spark.createDataFrame([("m", "m2")], "model string, model2 string")
    return det.pair_mismatches(first.unionByName(second), pairs).select("sample_id", "reason")


_PADDED = """SELECT label AS sample_id, vec_id, vec_id % 5 = 0 AS is_pad, lp FROM soft WHERE tok = label"""


@query("prob_masked_mean", sql(("long", _LONG), ("soft", _SOFT), ("padded", _PADDED), select=f"""
      SELECT sample_id, {sql6('avg(lp) FILTER (NOT is_pad)')} AS masked, {sql6('avg(lp)')} AS unmasked FROM padded GROUP BY sample_id"""))
def prob_masked_mean(spark, folder):
    """Mean log probability per label group with and without padded positions."""
    stats = det.statistics_from_logits(_logits(spark, folder).withColumn(
        "label_pad", ~pr.padding_mask(F.col("sample_id") % 5, 0)).withColumn("pos", F.lit(0)))
    grouped = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    rows = stats.join(grouped, "sample_id").groupBy(F.col("label").alias("group"))
    return rows.agg(
        r6(det.log_likelihood()).alias("masked"), r6(F.avg("logprob")).alias("unmasked")
    ).withColumnRenamed("group", "sample_id")


@query("prob_temperature", sql(("raw", _LONG), ("long", "SELECT vec_id, label, x / 0.5e0 AS x, tok FROM raw"), ("soft", _SOFT), select=f"""
      SELECT vec_id AS sample_id, {sql6('max(CASE WHEN tok = label THEN lp END)')} AS logprob, {sql6('-sum(exp(lp) * lp)')} AS entropy
      FROM soft GROUP BY vec_id"""))
def prob_temperature(spark, folder):
    stats = det.statistics_from_logits(_logits(spark, folder), temperature=0.5)
    return stats.select("sample_id", r6("logprob").alias("logprob"), r6("entropy").alias("entropy"))


@query("token_dist_detectors", sql(("long", _LONG), ("soft", _SOFT),
       ("steps", """SELECT vec_id // 10 AS sample_id, vec_id, label, lead(label) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS nxt FROM embeddings"""),
       select=f"""SELECT sample_id, {sql6('avg(lp)')} AS loglikelihood, {sql6('avg(e)')} AS entropy, {sql6('avg(r)')} AS rank FROM
       (SELECT st.sample_id, st.vec_id, max(s.lp) FILTER (s.tok = st.nxt) AS lp, -sum(exp(s.lp) * s.lp) AS e, 1 + count(*) FILTER (s.x > o.x) AS r
        FROM steps st JOIN soft s ON s.vec_id = st.vec_id JOIN soft o ON o.vec_id = st.vec_id AND o.tok = st.nxt
        WHERE st.nxt IS NOT NULL GROUP BY ALL) GROUP BY sample_id"""))
def token_dist_detectors(spark, folder):
    """Detectors over a table of logits: ten consecutive vectors make one sample."""
    dist = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("sample_id"), F.lit("m").alias("model"),
        (F.col("vec_id") % 10).cast("int").alias("pos"), F.col("label").alias("token_id"),
        F.lit(False).alias("is_pad"), F.col("embedding").alias("logits"),
    )
    stats = det.statistics_from_logits(det.shift_labels(dist))
    wanted = {n: d for n, d in det.detectors().items() if not d.needs_pair}
    scores = det.score(stats, wanted)
    return scores.groupBy("sample_id").pivot("Detector", list(wanted)).agg(r6(F.first("Value")))


_DIRECT = """SELECT chars.sample_id, sum(ln(p)) AS s FROM chars JOIN dense ON dense.model = 'en' AND dense.ctx = chars.ctx AND dense.token = chars.token GROUP BY ALL"""


@query("custom_detector", sql(*_BASE, ("short", _SHORT), ("direct", _DIRECT), select=f"""
      SELECT sample_id, {sql6('exp(-s / n)')} AS Value FROM direct JOIN (SELECT sample_id, count(ctx) AS n FROM chars GROUP BY ALL) USING (sample_id)
      UNION ALL SELECT sample_id, NULL FROM short WHERE model = 'en'"""))
def custom_detector(spark, folder):
    """A user's detector (perplexity) is one more aggregate."""
    counted = ngram.bigram_counts(corpus(spark, folder), ["sample_id", "model"])
    stats = ngram.token_statistics(counted, ngram.train(counted, ("en",)))
    perplexity = det.Detector(F.exp(-F.try_divide(F.sum(F.col("n") * F.col("logprob")), F.sum("n"))))
    return det.score(stats, {"perplexity": perplexity}).select("sample_id", r6("Value").alias("Value"))


def _own_alphabet(batches):
    """A model that finds every character a text uses equally likely."""
    import numpy as np
    import pandas as pd

    for batch in batches:
        texts = batch["Code"].fillna("")
        kinds = texts.map(lambda text: len(set(text))).clip(lower=1)
        frame = pd.DataFrame({"sample_id": batch["sample_id"], "model": "own", "model2": None, "n": texts.str.len()})
        yield frame.assign(
            logprob=-np.log(kinds), entropy=np.log(kinds), rank=1.0, mu=np.nan, var=np.nan, xent=np.nan, is_pad=False
        )


@query("custom_model", f"""SELECT doc_id AS sample_id, unnest(['loglikelihood', 'entropy', 'rank']) AS Detector,
    unnest([{sql6('-ln(k)')}, {sql6('ln(k)')}, CASE WHEN k IS NOT NULL THEN 1e0 END]) AS Value
    FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN len(list_distinct(string_split(text, ''))) END AS k FROM documents)""")
def custom_model(spark, folder):
    """A user's model behind the built-in detectors, in Arrow batches."""
    docs = corpus(spark, folder).select("sample_id", "Code")
    wanted = {n: d for n, d in det.detectors().items() if not d.needs_pair}
    scores = det.score(det.statistics_from_model(docs, _own_alphabet), wanted)
    return scores.select("sample_id", "Detector", r6("Value").alias("Value"))
