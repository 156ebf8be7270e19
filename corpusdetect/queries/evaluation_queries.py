"""AUROC, ROC, heatmap and trend queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scores import FLIPPED, SCORE_CAP, default_setting
from ..operators import evaluation as ev
from ..operators import filters as flt
from ..operators import heatmaps as hm
from ..operators import trends as tr
from .registry import query, r6, sql6
from .views import AFTER, BEFORE, DETECTORS, GENERATORS, canonical_sql, detections, samples, sql, table

_FLIP = "('" + "', '".join(FLIPPED) + "')"
_FINITE = f"""CASE WHEN Value IS NULL OR isnan(Value)
      THEN CASE WHEN Generator = 'human' THEN {SCORE_CAP}e0 ELSE -{SCORE_CAP}e0 END
      WHEN isinf(Value) THEN CASE WHEN Value > 0 THEN {SCORE_CAP}e0 ELSE -{SCORE_CAP}e0 END
      ELSE Value END"""
_SETTING = "((TopP = 0.95e0 AND Temperature = 0.97e0) OR Generator = 'human')"
_WHITE = "(Generator = BaseModel OR Generator = 'human')"


def _quoted(values) -> str:
    return "('" + "', '".join(values) + "')"


def scored(source: str = "detections", flip: bool = True, where: str = "TRUE") -> str:
    """Rows with the oriented score ``v``."""
    v = f"CASE WHEN Detector IN {_FLIP} THEN -({_FINITE}) ELSE {_FINITE} END" if flip else _FINITE
    return f"SELECT *, {v} AS v FROM {source} WHERE {where}"


def areas(source: str = "scored", by: str = "Detector, BaseModel", ai_by: str = "Generator") -> str:
    """AUROC by comparing every human with every generated score."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"h.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
    shown = ", ".join(f"a.{k}" for k in keys) + (f", a.{ai_by}" if ai_by else "")
    return f"""SELECT {shown}, count(DISTINCT h.sample_id) AS n_human, count(DISTINCT a.sample_id) AS n_ai,
      avg(CASE WHEN a.v > h.v THEN 1e0 WHEN a.v = h.v THEN 0.5e0 ELSE 0e0 END) AS auroc
    FROM {source} h JOIN {source} a ON {on} AND h.Generator = 'human' AND a.Generator <> 'human'
    GROUP BY {shown}"""


_AREA = f"SELECT *, {sql6('auroc')} AS a6 FROM areas"


def _shown(columns: str, source: str = "areas") -> str:
    return f"SELECT {columns}, n_human, n_ai, {sql6('auroc')} AS auroc FROM {source}"


def _rounded(df):
    return df.withColumn("auroc", r6("auroc"))


@query(
    "quality_auroc",
    f"""WITH s AS (SELECT lang, quality, n_chars, doc_id FROM documents JOIN labels USING (doc_id))
    SELECT a.lang AS BaseModel, count(DISTINCT h.doc_id) AS n_human, count(DISTINCT a.doc_id) AS n_ai,
      {sql6("avg(CASE WHEN a.n_chars > h.n_chars THEN 1e0 WHEN a.n_chars = h.n_chars THEN 0.5e0 ELSE 0e0 END)")} AS auroc
    FROM s h JOIN s a ON h.lang = a.lang AND h.quality = 1 AND a.quality = 0 GROUP BY a.lang""",
)
def quality_auroc(spark, folder):
    """How well the length of a document tells low from high quality, per language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").select(
        F.lit("length").alias("Detector"),
        F.col("lang").alias("BaseModel"),
        F.when(F.col("quality") == 1, F.lit("human")).otherwise(F.lit("low")).alias("Generator"),
        F.col("n_chars").cast("double").alias("Value"),
    )
    return _rounded(ev.auroc(rows, ai_by=())).drop("Detector")


@query("auroc_by_detector", sql("samples", "detections", ("scored", scored()), ("areas", areas()),
       select=_shown("Detector, BaseModel, Generator")))
def auroc_by_detector(spark, folder):
    return _rounded(ev.auroc(detections(spark, folder), flip=FLIPPED))


@query("auroc_white_box", sql("samples", "detections", ("scored", scored(where=f"{_WHITE} AND {_SETTING}")),
       ("areas", areas(ai_by="")), select=_shown("Detector, BaseModel")))
def auroc_white_box(spark, folder):
    rows = flt.white_box()(detections(spark, folder).filter(default_setting()))
    return _rounded(ev.auroc(rows, ai_by=(), flip=FLIPPED))


@query("auroc_pooled", sql("samples", "detections", ("scored", scored()), ("areas", areas(ai_by="")),
       select=_shown("Detector, BaseModel")))
def auroc_pooled(spark, folder):
    """All generators together against human rows."""
    return _rounded(ev.auroc(detections(spark, folder), ai_by=(), flip=FLIPPED))


@query("auroc_generator_override", sql("samples", "detections",
       ("scored", scored(where="Generator IN ('gen-b', 'human') AND BaseModel = 'gen-a'")),
       ("areas", areas(ai_by="")), select=_shown("Detector, BaseModel")))
def auroc_generator_override(spark, folder):
    keep = flt.chain([flt.generator("gen-b"), flt.base_model("gen-a")])
    return _rounded(ev.auroc(keep(detections(spark, folder)), ai_by=(), flip=FLIPPED))


@query("auroc_secondary_split", sql("samples", "detections", ("scored", scored()),
       ("areas", areas(by="Detector, BaseModel, SecondaryModel")),
       select=_shown("Detector, BaseModel, SecondaryModel, Generator")))
def auroc_secondary_split(spark, folder):
    by = ("Detector", "BaseModel", "SecondaryModel")
    return _rounded(ev.auroc(detections(spark, folder), by=by, flip=FLIPPED))


@query("auroc_second_model", sql("samples", "detections",
       ("scored", scored(where="SecondaryModel = 'gen-b'")), ("areas", areas()),
       select=_shown("Detector, BaseModel, Generator")))
def auroc_second_model(spark, folder):
    return _rounded(ev.auroc(flt.second_model("gen-b")(detections(spark, folder)), flip=FLIPPED))


@query("auroc_single_model", sql("samples", "detections",
       ("scored", scored(where="SecondaryModel IS NULL")), ("areas", areas()),
       select=_shown("Detector, BaseModel, Generator")))
def auroc_single_model(spark, folder):
    return _rounded(ev.auroc(flt.second_model(None)(detections(spark, folder)), flip=FLIPPED))


@query("auroc_nonfinite_flip", sql("samples", "detections", ("scored", scored(flip=False)), ("areas", areas()),
       ("turned", scored()), ("flipped", areas("turned")),
       select=f"""SELECT a.Detector, a.BaseModel, a.Generator, {sql6('a.auroc')} AS plain, {sql6('f.auroc')} AS flipped
       FROM areas a JOIN flipped f USING (Detector, BaseModel, Generator)"""))
def auroc_nonfinite_flip(spark, folder):
    key = ["Detector", "BaseModel", "Generator"]
    rows = detections(spark, folder)
    plain = ev.auroc(rows).select(*key, r6("auroc").alias("plain"))
    turned = ev.auroc(rows, flip=FLIPPED).select(*key, r6("auroc").alias("flipped"))
    return plain.join(turned, key)


_LATE = f"""SELECT *, CASE WHEN Value IS NULL OR isnan(Value)
      THEN CASE WHEN Generator = 'human' THEN {SCORE_CAP}e0 ELSE -{SCORE_CAP}e0 END
      ELSE CASE WHEN Detector IN {_FLIP} THEN -1e0 ELSE 1e0 END
         * CASE WHEN isinf(Value) THEN CASE WHEN Value > 0 THEN {SCORE_CAP}e0 ELSE -{SCORE_CAP}e0 END
                ELSE Value END END AS v FROM detections"""


@query("auroc_pessimistic_after_flip", sql("samples", "detections", ("scored", _LATE), ("areas", areas()),
       select=_shown("Detector, BaseModel, Generator")))
def auroc_pessimistic_after_flip(spark, folder):
    rows = detections(spark, folder)
    return _rounded(ev.auroc(rows, flip=FLIPPED, pessimistic_after_flip=True))


@query("auroc_single_class_skip", sql("samples", "detections",
       ("kept", "SELECT * FROM detections WHERE Generator <> 'human' OR Language = 'python'"),
       ("scored", scored("kept")), ("areas", areas(by="Language, Detector, BaseModel")),
       select=_shown("Language, Detector, BaseModel, Generator")))
def auroc_single_class_skip(spark, folder):
    """Languages left without human rows get no score."""
    rows = detections(spark, folder).filter((F.col("Generator") != "human") | (F.col("Language") == "python"))
    return _rounded(ev.auroc(rows, by=("Language", "Detector", "BaseModel"), flip=FLIPPED))


_SUMMARY = """SELECT Detector, avg(auroc) AS mean, stddev_pop(auroc) AS std, min(auroc) AS min, max(auroc) AS max
    FROM areas GROUP BY Detector"""
_R4 = ", ".join(f"{sql6(c)} AS {c}" for c in ("mean", "std", "min", "max"))


@query("auroc_summary", sql("samples", "detections", ("scored", scored(where=_WHITE)), ("areas", areas(ai_by="")),
       ("summary", _SUMMARY), select=f"SELECT Detector, {_R4} FROM summary"))
def auroc_summary(spark, folder):
    scores = ev.auroc(flt.white_box()(detections(spark, folder)), ai_by=(), flip=FLIPPED)
    return ev.auroc_summary(scores).select("Detector", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("auroc_overall", sql("samples", "detections", ("scored", scored(where=_WHITE)), ("areas", areas(ai_by="")),
       ("summary", _SUMMARY),
       select=f"SELECT {sql6('avg(mean)')} AS mean, {sql6('avg(std)')} AS std FROM summary"))
def auroc_overall(spark, folder):
    scores = ev.auroc(flt.white_box()(detections(spark, folder)), ai_by=(), flip=FLIPPED)
    return ev.overall_summary(ev.auroc_summary(scores)).select(r6("mean").alias("mean"), r6("std").alias("std"))


@query("auroc_ranking", sql("samples", "detections", ("scored", scored(where=_WHITE)), ("areas", areas(ai_by="")),
       select=f"""SELECT Detector, BaseModel, {sql6('auroc')} AS auroc, CAST(row_number() OVER
       (PARTITION BY Detector ORDER BY {sql6('auroc')} DESC, BaseModel) AS INTEGER) AS place FROM areas"""))
def auroc_ranking(spark, folder):
    scores = ev.auroc(flt.white_box()(detections(spark, folder)), ai_by=(), flip=FLIPPED)
    return ev.auroc_ranking(_rounded(scores)).select("Detector", "BaseModel", "auroc", "place")


_PERIOD = (f"SELECT *, CASE WHEN Dataset IN {_quoted(BEFORE)} THEN 'pre' WHEN Dataset IN {_quoted(AFTER)} "
           f"THEN 'post' END AS period FROM detections WHERE {_SETTING} AND {_WHITE}")


@query("auroc_pre_post", sql("samples", "detections", ("periods", _PERIOD), ("scored", scored("periods")),
       ("areas", areas(by="period, Detector, BaseModel", ai_by="")),
       select=_shown("period, Detector, BaseModel")))
def auroc_pre_post(spark, folder):
    """White-box AUROC on corpora from before and after generators were common."""
    period = F.when(F.col("Dataset").isin(*BEFORE), "pre").when(F.col("Dataset").isin(*AFTER), "post")
    rows = flt.white_box()(detections(spark, folder).filter(default_setting())).withColumn("period", period)
    return _rounded(ev.auroc(rows, by=("period", "Detector", "BaseModel"), ai_by=(), flip=FLIPPED))


@query("auroc_by_dataset", sql("samples", "detections", ("scored", scored(where="Dataset IN ('hf_apps', 'stackoverflow-post')")),
       ("areas", areas(by="Dataset, Detector, BaseModel")),
       select=_shown("Dataset, Detector, BaseModel, Generator")))
def auroc_by_dataset(spark, folder):
    rows = flt.corpus(["hf_apps", "stackoverflow-post"])(detections(spark, folder))
    return _rounded(ev.auroc(rows, by=("Dataset", "Detector", "BaseModel"), flip=FLIPPED))


def _roc(by: str, *before, **rows) -> str:
    """Points of the curves of (by…, Generator): counts per threshold, cumulated."""
    keys = [k.strip() for k in by.split(",")]
    cell, cells = f"{by}, Generator", ", ".join(f"c.{k}" for k in [*keys, "Generator"])
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    counts = f"""SELECT {cells}, s.v, count(*) FILTER (s.Generator = 'human') AS hc,
      count(*) FILTER (s.Generator <> 'human') AS ac
    FROM (SELECT DISTINCT {cell} FROM scored WHERE Generator <> 'human') c
    JOIN scored s ON {on} AND s.Generator IN ('human', c.Generator)
    GROUP BY ALL"""
    steps = f"""SELECT *, sum(hc) OVER w AS fp, sum(ac) OVER w AS tp, lead(hc) OVER w AS nh, lead(ac) OVER w AS na,
      row_number() OVER w AS rn, sum(hc) OVER p AS th, sum(ac) OVER p AS ta
    FROM roc WINDOW w AS (PARTITION BY {cell} ORDER BY v DESC), p AS (PARTITION BY {cell})"""
    return sql("samples", "detections", *before, ("scored", scored(**rows)), ("roc", counts), ("steps", steps),
        select=f"""SELECT {cell}, {sql6('fp / th::DOUBLE')} AS fpr, {sql6('tp / ta::DOUBLE')} AS tpr,
         {sql6('v')} AS threshold FROM steps
       WHERE th > 0 AND ta > 0 AND (rn = 1 OR nh IS NULL OR nh <> hc OR na <> ac)
       UNION ALL SELECT DISTINCT {cell}, 0e0, 0e0, 'Infinity'::DOUBLE FROM steps WHERE th > 0 AND ta > 0""")


def _points(rows, by=("Detector", "BaseModel")):
    curve = ev.roc_curve(rows, by=by, flip=FLIPPED)
    cut = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(r6("threshold"))
    return curve.select(*by, "Generator", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), cut.alias("threshold"))


_ROC_CORPORA = ["hf_codesearchnet-python", "hf_apps", "stackoverflow-post"]


@query("roc_curve_points", _roc("Detector, BaseModel", where=f"Dataset IN {_quoted(_ROC_CORPORA)} AND {_SETTING}"))
def roc_curve_points(spark, folder):
    """Three corpora taken together."""
    return _points(flt.corpus(_ROC_CORPORA)(detections(spark, folder)).filter(default_setting()))


@query("roc_curve_by_corpus", _roc("Dataset, Detector, BaseModel",
       where=f"Dataset IN {_quoted(_ROC_CORPORA)} AND Language = 'python' AND {_SETTING}"))
def roc_curve_by_corpus(spark, folder):
    """A curve per corpus, of Python code only."""
    keep = flt.chain([flt.corpus(_ROC_CORPORA), flt.languages(["python"])])
    rows = keep(detections(spark, folder)).filter(default_setting())
    return _points(rows, ("Dataset", "Detector", "BaseModel"))


@query("roc_curve_second_split", _roc("Detector, BaseModel, SecondaryModel"))
def roc_curve_second_split(spark, folder):
    """Curves per second model; detectors of one model have none and keep their curve."""
    return _points(detections(spark, folder), ("Detector", "BaseModel", "SecondaryModel"))


# ---------------------------------------------------------------- heatmaps

_GENS = (*GENERATORS, "gen-x")
_AXES = (
    f"SELECT unnest({list(DETECTORS)}) AS Detector, g.Generator, b.BaseModel "
    f"FROM (SELECT unnest({list(_GENS)}) AS Generator) g, (SELECT unnest({list(GENERATORS)}) AS BaseModel) b"
)
_CELLS = """SELECT Detector, Generator, BaseModel, coalesce(auroc, 0e0) AS value, auroc IS NOT NULL AS has_data
    FROM axes LEFT JOIN areas USING (Detector, Generator, BaseModel)"""
_HEAT = ("samples", "detections", ("scored", scored(flip=False, where=f"{_SETTING}")), ("areas", areas()),
         ("axes", _AXES), ("cells", _CELLS))


def _cells(spark, folder):
    """Three generators and one without rows, so that empty cells occur."""
    rows = detections(spark, folder).filter(default_setting())
    return hm.heatmap(rows, _GENS, GENERATORS, DETECTORS)


def _value(df):
    return df.withColumn("value", r6("value"))


_V = f"{sql6('value')} AS value"


@query("heatmap_long", sql(*_HEAT, select=f"SELECT Detector, Generator, BaseModel, {_V}, has_data FROM cells"))
def heatmap_long(spark, folder):
    return _value(_cells(spark, folder))


@query("heatmap_max", sql(*_HEAT, select=f"SELECT Generator, BaseModel, {sql6('greatest(max(value), 0e0)')} AS value FROM cells GROUP BY ALL"))
def heatmap_max(spark, folder):
    return _value(hm.best_detector(_cells(spark, folder)))


@query("heatmap_display_flip", sql(*_HEAT, select=f"""SELECT Detector, Generator, BaseModel,
       {sql6(f"CASE WHEN Detector IN {_FLIP} THEN 1e0 - value ELSE value END")} AS value, has_data FROM cells"""))
def heatmap_display_flip(spark, folder):
    return _value(hm.display_flip(_cells(spark, folder)))


@query("heatmap_scale_bounds", sql(*_HEAT, select=f"""SELECT Detector, 0e0 AS vmin,
       {sql6(f"CASE WHEN Detector IN {_FLIP} THEN 1e0 - min(value) ELSE max(value) END")} AS vmax FROM cells GROUP BY Detector"""))
def heatmap_scale_bounds(spark, folder):
    return hm.scale_bounds(_cells(spark, folder)).select("Detector", "vmin", r6("vmax").alias("vmax"))


@query("heatmap_matrix", sql(*_HEAT, select='SELECT Detector, Generator, ' + ", ".join(
       f"""round({sql6(f"max(value) FILTER (BaseModel = '{b}')")}, 2) AS "{b}" """ for b in GENERATORS) + " FROM cells GROUP BY ALL"))
def heatmap_matrix(spark, folder):
    return hm.matrix(_value(_cells(spark, folder)), GENERATORS)


def _slice_axes(names: str) -> str:
    return f"SELECT * FROM (SELECT DISTINCT {names} FROM areas), ({_AXES.replace(str(list(_GENS)), str(list(GENERATORS)))})"


def _slice_cells(names: str) -> str:
    on = " AND ".join(f"x.{n.strip()} IS NOT DISTINCT FROM a.{n.strip()}"
                      for n in f"{names}, Detector, Generator, BaseModel".split(","))
    return f"SELECT x.*, coalesce(a.auroc, 0e0) AS value, a.auroc IS NOT NULL AS has_data FROM axes x LEFT JOIN areas a ON {on}"


def _sliced(names: str, select: str, source: str = "detections", where: str = "TRUE", *more) -> str:
    return sql("samples", "detections", *more, ("scored", scored(source, flip=False, where=where)),
               ("areas", areas(by=f"{names}, Detector, BaseModel")), ("axes", _slice_axes(names)),
               ("cells", _slice_cells(names)), select=select)


@query("heatmap_by_dataset", _sliced("Dataset", f"SELECT Dataset, Detector, Generator, BaseModel, {_V}, has_data FROM cells", where=_SETTING))
def heatmap_by_dataset(spark, folder):
    rows = detections(spark, folder).filter(default_setting())
    return _value(hm.heatmap(rows, GENERATORS, GENERATORS, DETECTORS, by=("Dataset",)))


@query("heatmap_by_language", _sliced("Dataset, Language", f"SELECT Dataset, Language, Detector, Generator, BaseModel, {_V}, has_data FROM cells"))
def heatmap_by_language(spark, folder):
    rows = detections(spark, folder)
    return _value(hm.heatmap(rows, GENERATORS, GENERATORS, DETECTORS, by=("Dataset", "Language")))


@query("heatmap_python_only", sql("samples", "detections", ("scored", scored(flip=False, where="Language = 'python'")),
       ("areas", areas()), ("axes", _AXES), ("cells", _CELLS),
       select=f"SELECT Detector, Generator, BaseModel, {_V}, has_data FROM cells"))
def heatmap_python_only(spark, folder):
    rows = flt.languages(["python"])(detections(spark, folder))
    return _value(hm.heatmap(rows, _GENS, GENERATORS, DETECTORS))


@query("heatmap_by_language_usual", _sliced("Dataset, Language",
       f"SELECT Dataset, Language, Detector, Generator, BaseModel, {_V}, has_data FROM cells", where=_SETTING))
def heatmap_by_language_usual(spark, folder):
    """Per corpus and language under the usual sampling setting."""
    rows = detections(spark, folder).filter(default_setting())
    return _value(hm.heatmap(rows, GENERATORS, GENERATORS, DETECTORS, by=("Dataset", "Language")))


@query("heatmap_python_usual", _sliced("Dataset", f"SELECT Dataset, Detector, Generator, BaseModel, {_V}, has_data FROM cells",
       where=f"Language = 'python' AND {_SETTING}"))
def heatmap_python_usual(spark, folder):
    """Python code per corpus under the usual sampling setting."""
    rows = flt.languages(["python"])(detections(spark, folder)).filter(default_setting())
    return _value(hm.heatmap(rows, GENERATORS, GENERATORS, DETECTORS, by=("Dataset",)))


_SETTINGS = [(p, t) for t in (0.2, 0.97) for p in (0.5, 0.95)]
_BY_SETTING = "SELECT d.*, s.p AS setting_p, s.t AS setting_t FROM detections d JOIN (VALUES " + ", ".join(
    f"({p}e0, {t}e0)" for p, t in _SETTINGS) + ") s(p, t) ON d.Generator = 'human' OR (d.TopP = s.p AND d.Temperature = s.t)"


def _by_setting(rows):
    """Human rows count in every setting, generated ones in their own."""
    settings = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in _SETTINGS])
    own = F.array(F.struct(F.col("TopP").alias("p"), F.col("Temperature").alias("t")))
    chosen = F.when(F.col("Generator") == "human", settings).otherwise(own)
    return rows.withColumn("s", F.explode(chosen)).select(
        *rows.columns, F.col("s.p").alias("setting_p"), F.col("s.t").alias("setting_t")
    )


@query("heatmap_by_setting", _sliced("setting_p, setting_t",
       f"SELECT setting_p, setting_t, Detector, Generator, BaseModel, {_V}, has_data FROM cells", "grid", "TRUE", ("grid", _BY_SETTING)))
def heatmap_by_setting(spark, folder):
    rows = _by_setting(detections(spark, folder))
    return _value(hm.heatmap(rows, GENERATORS, GENERATORS, DETECTORS, by=("setting_p", "setting_t")))


@query("heatmap_second_split", _sliced("SecondaryModel", f"SELECT SecondaryModel, Detector, Generator, BaseModel, {_V}, has_data FROM cells"))
def heatmap_second_split(spark, folder):
    return _value(hm.heatmap(detections(spark, folder), GENERATORS, GENERATORS, DETECTORS, split_second=True))


# ------------------------------------------------------ corpus differences

_PAIR = ("stackoverflow-post", "stackoverflow-pre")
_DIFF = """SELECT c.Detector, c.Generator, c.BaseModel, c.auroc AS comparison, b.auroc AS base, c.auroc - b.auroc AS diff
    FROM areas c JOIN areas b USING (Detector, Generator, BaseModel)
    WHERE c.Dataset = 'stackoverflow-post' AND b.Dataset = 'stackoverflow-pre'"""
_DIFFS = ("samples", "detections", ("scored", scored(flip=False)),
          ("areas", areas(by="Dataset, Detector, BaseModel")), ("diffs", _DIFF))


def _by_corpus(rows):
    """AUROCs of all corpora in one pass, to be paired afterwards."""
    return ev.auroc(rows, by=("Dataset", "Detector", "BaseModel"))


def _pair(scores, comparison, base, by=()):
    return hm.difference(scores.filter(F.col("Dataset") == comparison), scores.filter(F.col("Dataset") == base), by)


def _diffs(spark, folder):
    return _pair(_by_corpus(flt.corpus(_PAIR)(detections(spark, folder))), *_PAIR)


@query("diff_heatmap", sql(*_DIFFS, select=f"""SELECT Detector, Generator, BaseModel, {sql6('comparison')} AS comparison,
       {sql6('base')} AS base, {sql6('diff')} AS diff FROM diffs"""))
def diff_heatmap(spark, folder):
    return _diffs(spark, folder).select(
        "Detector", "Generator", "BaseModel", *[r6(c).alias(c) for c in ("comparison", "base", "diff")]
    )


_ORD = "list_position([" + ", ".join(f"'{d}'" for d in DETECTORS) + "], Detector)"


@query("diff_signed_max", sql(*_DIFFS, select=f"""SELECT Generator, BaseModel, {sql6('diff')} AS diff FROM (SELECT *, row_number() OVER
       (PARTITION BY Generator, BaseModel ORDER BY abs(diff) DESC, {_ORD}) AS rn FROM
       (SELECT Detector, Generator, BaseModel, {sql6('diff')} AS diff FROM diffs)) WHERE rn = 1"""))
def diff_signed_max(spark, folder):
    diffs = _diffs(spark, folder).withColumn("diff", r6("diff"))
    return hm.widest_difference(diffs, DETECTORS)


@query("diff_scale_bounds", sql(*_DIFFS, select=f"""SELECT Detector,
       {sql6(f"CASE WHEN Detector IN {_FLIP} THEN -max(diff) ELSE min(diff) END")} AS vmin,
       {sql6(f"CASE WHEN Detector IN {_FLIP} THEN -min(diff) ELSE max(diff) END")} AS vmax FROM diffs GROUP BY Detector"""))
def diff_scale_bounds(spark, folder):
    cells = _diffs(spark, folder).withColumnRenamed("diff", "value")
    return hm.scale_bounds(cells, difference=True).select("Detector", r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@query("diff_diagonal", sql(*_DIFFS, select=f"""SELECT d.Detector, d.Generator, d.BaseModel,
       {sql6("CASE WHEN d.Generator = d.BaseModel THEN 0e0 ELSE d.diff - (g.diff + b.diff) / 2e0 END")} AS diff
       FROM diffs d JOIN diffs g ON g.Detector = d.Detector AND g.Generator = d.Generator AND g.BaseModel = d.Generator
       JOIN diffs b ON b.Detector = d.Detector AND b.Generator = d.BaseModel AND b.BaseModel = d.BaseModel"""))
def diff_diagonal(spark, folder):
    return hm.diagonal_adjusted(_diffs(spark, folder)).withColumn("diff", r6("diff"))


@query("paired_scores", sql(*_DIFFS, select=f"""SELECT Detector, CAST(row_number() OVER (PARTITION BY Detector ORDER BY Generator, BaseModel)
       AS INTEGER) AS place, {sql6('comparison')} AS comparison, {sql6('base')} AS base FROM diffs"""))
def paired_scores(spark, folder):
    rows = hm.paired_scores(_diffs(spark, folder), GENERATORS, GENERATORS)
    return rows.withColumn("comparison", r6("comparison")).withColumn("base", r6("base"))


# Which corpus is compared with which.
_CORPUS_PAIRS = [
    ("stackoverflow-post", "hf_codesearchnet-python"),
    ("stackoverflow-post", "hf_apps"),
    ("stackoverflow-post", "stackoverflow-pre"),
    ("leetcode-post", "hf_leetcode-pre"),
]
_PAIR_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _CORPUS_PAIRS)


@query("diff_pairs", sql("samples", "detections", ("scored", scored(flip=False)),
       ("areas", areas(by="Dataset, Detector, BaseModel")),
       select=f"""SELECT p.c AS comparison_set, p.b AS base_set, c.Detector, c.Generator, c.BaseModel, {sql6('c.auroc - b.auroc')} AS diff
       FROM (VALUES {_PAIR_VALUES}) p(c, b) JOIN areas c ON c.Dataset = p.c
       JOIN areas b ON b.Dataset = p.b AND b.Detector = c.Detector AND b.Generator = c.Generator AND b.BaseModel = c.BaseModel"""))
def diff_pairs(spark, folder):
    return _paired(_by_corpus(detections(spark, folder)), "Dataset", _CORPUS_PAIRS)


@query("diff_second_split", sql("samples", "detections", ("scored", scored(flip=False)),
       ("areas", areas(by="Dataset, Detector, BaseModel, SecondaryModel")),
       select=f"""SELECT c.Detector, c.Generator, c.BaseModel, c.SecondaryModel, {sql6('c.auroc - b.auroc')} AS diff
       FROM areas c JOIN areas b ON b.Detector = c.Detector AND b.Generator = c.Generator AND b.BaseModel = c.BaseModel
         AND b.SecondaryModel IS NOT DISTINCT FROM c.SecondaryModel
       WHERE c.Dataset = 'stackoverflow-post' AND b.Dataset = 'stackoverflow-pre'"""))
def diff_second_split(spark, folder):
    """Differences per second model, where detectors of one model have none."""
    scores = ev.auroc(detections(spark, folder), by=("Dataset", "Detector", "BaseModel", "SecondaryModel"))
    of = lambda corpus: scores.filter(F.col("Dataset") == corpus)
    rows = hm.difference(of("stackoverflow-post"), of("stackoverflow-pre"), by=("SecondaryModel",))
    return rows.select("Detector", "Generator", "BaseModel", "SecondaryModel", r6("diff").alias("diff"))


_PAIRS_SQL = f"""SELECT p.c AS comparison_set, p.b AS base_set, c.Detector, c.Generator, c.BaseModel, {sql6('c.auroc - b.auroc')} AS diff
       FROM (VALUES {_PAIR_VALUES}) p(c, b) JOIN areas c ON c.Dataset = p.c
       JOIN areas b ON b.Dataset = p.b AND b.Detector = c.Detector AND b.Generator = c.Generator AND b.BaseModel = c.BaseModel"""


@query("diff_pairs_python", sql("samples", "detections",
       ("scored", scored(flip=False, where="Language = 'python'")),
       ("areas", areas(by="Dataset, Detector, BaseModel")), select=_PAIRS_SQL))
def diff_pairs_python(spark, folder):
    """The corpus pairs for Python code."""
    rows = flt.languages(["python"])(detections(spark, folder))
    return _paired(_by_corpus(rows), "Dataset", _CORPUS_PAIRS)


@query("diff_pairs_usual", sql("samples", "detections", ("scored", scored(flip=False, where=_SETTING)),
       ("areas", areas(by="Dataset, Detector, BaseModel")), select=_PAIRS_SQL))
def diff_pairs_usual(spark, folder):
    """The corpus pairs under the usual sampling setting."""
    return _paired(_by_corpus(detections(spark, folder).filter(default_setting())), "Dataset", _CORPUS_PAIRS)


def _paired(scores, column, pairs, on=("Detector", "Generator", "BaseModel")):
    """Differences of many slice pairs in one equi-join on the cell and the pair."""
    listed = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(b).alias("b")) for c, b in pairs])
    matching = F.explode(F.filter(listed, lambda p: p["c"] == F.col(column))).alias("p")
    left = scores.select(*on, F.col("auroc").alias("ca"), matching).select(
        *on, "ca", F.col("p.c").alias("comparison_set"), F.col("p.b").alias("base_set")
    )
    right = scores.select(*on, F.col("auroc").alias("ba"), F.col(column).alias("base_set"))
    return left.join(right, [*on, "base_set"]).select(
        "comparison_set", "base_set", *on, r6(F.col("ca") - F.col("ba")).alias("diff")
    )


# The languages that are compared.
_LANGS = ["python", "java", "js", "csharp", "cpp", "go", "rust"]


@query("diff_languages", sql("samples", "detections", ("scored", scored(flip=False, where=f"Language IN {_quoted(_LANGS)}")),
       ("areas", areas(by="Language, Detector, BaseModel")),
       select=f"""SELECT c.Language AS comparison_set, b.Language AS base_set, Detector, Generator, BaseModel,
       {sql6('c.auroc - b.auroc')} AS diff FROM areas c JOIN areas b USING (Detector, Generator, BaseModel) WHERE c.Language <> b.Language"""))
def diff_languages(spark, folder):
    scores = ev.auroc(flt.languages(_LANGS)(detections(spark, folder)), by=("Language", "Detector", "BaseModel"))
    return _paired(scores, "Language", [(a, b) for a in _LANGS for b in _LANGS if a != b])


@query("diff_languages_usual", sql("samples", "detections", ("scored", scored(flip=False, where=f"Language IN {_quoted(_LANGS)} AND {_SETTING}")),
       ("areas", areas(by="Language, Detector, BaseModel")),
       select=f"""SELECT c.Language AS comparison_set, b.Language AS base_set, Detector, Generator, BaseModel,
       {sql6('c.auroc - b.auroc')} AS diff FROM areas c JOIN areas b USING (Detector, Generator, BaseModel) WHERE c.Language <> b.Language"""))
def diff_languages_usual(spark, folder):
    """All pairs of languages under the usual sampling setting."""
    rows = flt.languages(_LANGS)(detections(spark, folder).filter(default_setting()))
    scores = ev.auroc(rows, by=("Language", "Detector", "BaseModel"))
    return _paired(scores, "Language", [(a, b) for a in _LANGS for b in _LANGS if a != b])


# The corpora that are compared, in Python or in all languages, under the usual setting.
_PUBLISHED = {
    "python_only": [
        ("stackoverflow-post", "hf_codesearchnet-python"),
        ("stackoverflow-post", "hf_apps"),
        ("stackoverflow-post", "stackoverflow-pre"),
    ],
    "all": [("stackoverflow-post", "stackoverflow-pre"), ("leetcode-post", "hf_leetcode-pre")],
}
_PUBLISHED_VALUES = ", ".join(f"('{slice_}', '{a}', '{b}')" for slice_, pairs in _PUBLISHED.items() for a, b in pairs)


@query("diff_published", sql("samples", "detections",
       ("sliced", f"SELECT *, unnest(CASE WHEN Language = 'python' THEN ['all', 'python_only'] ELSE ['all'] END) AS slice FROM detections WHERE {_SETTING}"),
       ("scored", scored("sliced", flip=False)), ("areas", areas(by="slice, Dataset, Detector, BaseModel")),
       select=f"""SELECT p.slice, p.c AS comparison_set, p.b AS base_set, c.Detector, c.Generator, c.BaseModel, {sql6('c.auroc - b.auroc')} AS diff
       FROM (VALUES {_PUBLISHED_VALUES}) p(slice, c, b) JOIN areas c ON c.Dataset = p.c AND c.slice = p.slice
       JOIN areas b ON b.Dataset = p.b AND b.slice = p.slice AND b.Detector = c.Detector AND b.Generator = c.Generator AND b.BaseModel = c.BaseModel"""))
def diff_published(spark, folder):
    """Corpus pairs in Python and in all languages, both under the usual setting, from one pass."""
    rows = detections(spark, folder).filter(default_setting())
    slices = F.when(F.col("Language") == "python", F.array(F.lit("all"), F.lit("python_only"))).otherwise(F.array(F.lit("all")))
    scores = ev.auroc(rows.withColumn("slice", F.explode(slices)), by=("slice", "Dataset", "Detector", "BaseModel"))
    key = ["Detector", "Generator", "BaseModel", "slice"]
    parts = [_paired(scores.filter(F.col("slice") == name), "Dataset", pairs, key) for name, pairs in _PUBLISHED.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("diff_settings", sql("samples", "detections", ("grid", _BY_SETTING), ("scored", scored("grid", flip=False)),
       ("areas", areas(by="setting_p, setting_t, Detector, BaseModel")),
       select=f"""SELECT c.setting_p, c.setting_t, Detector, Generator, BaseModel, {sql6('c.auroc - b.auroc')} AS diff
       FROM areas c JOIN areas b USING (Detector, Generator, BaseModel)
       WHERE b.setting_p = 0.95e0 AND b.setting_t = 0.97e0 AND NOT (c.setting_p = 0.95e0 AND c.setting_t = 0.97e0)"""))
def diff_settings(spark, folder):
    """Every other sampling setting against the usual one."""
    scores = ev.auroc(_by_setting(detections(spark, folder)), by=("setting_p", "setting_t", "Detector", "BaseModel"))
    usual = (F.col("setting_p") == 0.95) & (F.col("setting_t") == 0.97)
    key = ["Detector", "Generator", "BaseModel"]
    base = scores.filter(usual).select(*key, F.col("auroc").alias("ba"))
    return scores.filter(~usual).join(base, key).select(
        "setting_p", "setting_t", *key, r6(F.col("auroc") - F.col("ba")).alias("diff")
    )


# ------------------------------------------------------------------ trends

# Attributes of a model, from what it has generated: the date of its latest sample, the mean share of
# distinct characters in its texts, and the sum of their lengths. A model without samples has no date
# and size 0.
_ATTRS = """SELECT m AS model, max(Date) AS training_epoch,
    avg(CASE WHEN length(Code) > 0 THEN len(list_distinct(string_split(Code, ''))) / length(Code)::DOUBLE END) AS benchmark_score,
    coalesce(sum(length(Code)), 0)::BIGINT AS size
    FROM (SELECT unnest(['gen-a', 'gen-b', 'gen-c', 'gen-x']) AS m) LEFT JOIN samples ON Generator = m GROUP BY m"""
_TREND = ("samples", "detections", ("scored", scored(where=_WHITE)), ("areas", areas(ai_by="")), ("attrs", _ATTRS))


def _registry(spark, folder):
    kinds = F.size(F.array_distinct(F.filter(F.split("Code", ""), lambda c: c != "")))
    made = samples(spark, folder).groupBy(F.col("Generator").alias("model")).agg(
        F.max("Date").alias("training_epoch"),
        F.avg(F.when(F.length("Code") > 0, kinds / F.length("Code"))).alias("benchmark_score"),
        F.sum(F.length("Code")).alias("size"),
    )
    models = spark.createDataFrame([(m,) for m in _GENS], "model string")
    return models.join(made, "model", "left").fillna(0, ["size"])


def _white_scores(spark, folder):
    return ev.auroc(flt.white_box()(detections(spark, folder)), ai_by=(), flip=FLIPPED)


@query("auroc_vs_attribute", sql(*_TREND, select=f"""SELECT Detector, BaseModel, {sql6('auroc')} AS auroc, size::DOUBLE AS attribute
       FROM areas JOIN attrs ON model = BaseModel WHERE size IS NOT NULL AND size <> 0"""))
def auroc_vs_attribute(spark, folder):
    points = tr.with_attribute(_white_scores(spark, folder), _registry(spark, folder), "size")
    return _rounded(points).select("Detector", "BaseModel", "auroc", "attribute")


@query("auroc_trend", sql(*_TREND, select=f"""SELECT Detector, {sql6('regr_slope(auroc, benchmark_score)')} AS slope,
       {sql6('regr_intercept(auroc, benchmark_score)')} AS intercept, count(*) AS models
       FROM areas JOIN attrs ON model = BaseModel WHERE benchmark_score <> 0 GROUP BY Detector"""))
def auroc_trend(spark, folder):
    line = tr.trend(tr.with_attribute(_white_scores(spark, folder), _registry(spark, folder), "benchmark_score"))
    return line.withColumn("slope", r6("slope")).withColumn("intercept", r6("intercept"))


def _trend_sql(attribute: str) -> str:
    return sql(*_TREND, select=f"""SELECT Detector, {sql6(f'regr_slope(auroc, {attribute} / u)')} AS slope,
       {sql6(f'regr_intercept(auroc, {attribute} / u)')} AS intercept, count(*) AS models
       FROM areas JOIN attrs ON model = BaseModel, (SELECT max({attribute})::DOUBLE AS u FROM attrs)
       WHERE {attribute} <> 0 GROUP BY Detector""")


def _trend_of(spark, folder, attribute):
    """The line over the attribute in units of its largest value."""
    registry = _registry(spark, folder)
    unit = registry.agg(F.max(attribute).cast("double").alias("unit"))  # one row
    scaled = registry.crossJoin(F.broadcast(unit)).withColumn(attribute, F.col(attribute) / F.col("unit"))
    line = tr.trend(tr.with_attribute(_white_scores(spark, folder), scaled, attribute))
    return line.withColumn("slope", r6("slope")).withColumn("intercept", r6("intercept"))


@query("trend_training_date", _trend_sql("training_epoch"))
def trend_training_date(spark, folder):
    return _trend_of(spark, folder, "training_epoch")


@query("trend_model_size", _trend_sql("size"))
def trend_model_size(spark, folder):
    return _trend_of(spark, folder, "size")
