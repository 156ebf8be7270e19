"""Hand-computed results of the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from corpusdetect.functions import languages as lang
from corpusdetect.functions import probability as pr
from corpusdetect.functions import scores as sc
from corpusdetect.functions import text as tx
from corpusdetect.operators import detectors as det
from corpusdetect.operators import evaluation as ev
from corpusdetect.operators import filters as flt
from corpusdetect.operators import generation as gen
from corpusdetect.operators import grouping as gp
from corpusdetect.operators import heatmaps as hm
from corpusdetect.operators import setops as so
from corpusdetect.sources import normalise, stores

LENGTHS = [1024, 1, 512, 500, 1000, 128, 10]


def rows(spark, human, ai, detector="loglikelihood"):
    data = [(detector, "m", "human", v) for v in human] + [(detector, "m", "g", v) for v in ai]
    return spark.createDataFrame(data, "Detector string, BaseModel string, Generator string, Value double")


def area(spark, human, ai, **options):
    found = ev.auroc(rows(spark, human, ai, options.pop("detector", "loglikelihood")), **options).collect()
    return found[0].auroc if found else None


@pytest.mark.parametrize("diff, groups", [(100, [[1, 6], [5], [3, 2], [4, 0]]), (0.25, [[1], [6], [5], [3, 2], [4, 0]])])
def test_size_groups(spark, diff, groups):
    df = spark.createDataFrame(list(enumerate(LENGTHS)), "i int, length int")
    for fold_up_to in (1000, 0):
        found = {}
        for r in gp.size_groups(df, "length", diff, fold_up_to).orderBy("length").collect():
            found.setdefault(r.size_group, []).append(r.i)
        assert [found[g] for g in sorted(found)] == groups


def test_auroc_ties_and_extremes(spark):
    assert area(spark, [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]) == pytest.approx(7 / 9)
    assert area(spark, [1.0, 1.0], [1.0]) == 0.5
    assert area(spark, [1.0], [2.0]) == 1.0


def test_auroc_of_missing_scores(spark):
    nan = float("nan")
    assert area(spark, [1.0], [nan]) == 0.0
    assert area(spark, [1.0], [None]) == 0.0
    assert area(spark, [nan], [1.0]) == 0.0
    flipped = {"detector": "rank", "flip": ("rank",)}
    assert area(spark, [1.0], [nan], **flipped) == 1.0
    assert area(spark, [1.0], [nan], pessimistic_after_flip=True, **flipped) == 0.0


def test_auroc_needs_both_classes(spark):
    assert area(spark, [], [1.0]) is None
    assert area(spark, [1.0], []) is None


def test_auroc_symmetry_and_invariance(spark):
    human, ai = [0.1, 0.4, 0.4, 0.9, -2.0], [0.4, 0.5, 1.5, 0.0]
    plain = area(spark, human, ai)
    assert plain + area(spark, [-v for v in human], [-v for v in ai]) == pytest.approx(1)
    assert area(spark, [math.exp(v) for v in human], [math.exp(v) for v in ai]) == pytest.approx(plain)


def test_roc_curve_points(spark):
    # Scores 3 (ai), 2 (both), 1 (human), 0 (human): the point at 1 gains the
    # same counts as the one at 0 and is left out.
    curve = ev.roc_curve(rows(spark, [2.0, 1.0, 0.0], [3.0, 2.0])).orderBy(F.desc("threshold")).collect()
    points = [(round(r.fpr, 6), r.tpr, r.threshold) for r in curve]
    assert points == [(0.0, 0.0, math.inf), (0.0, 0.5, 3.0), (0.333333, 1.0, 2.0), (1.0, 1.0, 0.0)]


def test_roc_area_equals_auroc(spark):
    human, ai = [i % 7 / 3 for i in range(40)], [i % 5 / 2 for i in range(30)]
    points = sorted((r.fpr, r.tpr) for r in ev.roc_curve(rows(spark, human, ai)).collect())
    trapezoid = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert trapezoid == pytest.approx(area(spark, human, ai))


def test_widest_difference_keeps_the_earlier_detector(spark):
    names = ("a", "b", "c")
    data = [(n, "g", "m", d) for n, d in zip(names, (0.2, -0.3, 0.3))]
    df = spark.createDataFrame(data, "Detector string, Generator string, BaseModel string, diff double")
    assert hm.widest_difference(df, names).first().diff == -0.3


def test_diagonal_adjustment(spark):
    a, b, c, d = 0.5, 0.25, -0.5, 1.0
    data = [("x", g, m, v) for (g, m), v in zip([("p", "p"), ("p", "q"), ("q", "p"), ("q", "q")], (a, b, c, d))]
    df = spark.createDataFrame(data, "Detector string, Generator string, BaseModel string, diff double")
    found = {(r.Generator, r.BaseModel): r.diff for r in hm.diagonal_adjusted(df).collect()}
    assert found == {("p", "p"): 0, ("p", "q"): b - (a + d) / 2, ("q", "p"): c - (a + d) / 2, ("q", "q"): 0}


def stats_rows(spark, data):
    return spark.createDataFrame(
        data, "sample_id long, model string, model2 string, n long, logprob double, entropy double, rank double, "
        "mu double, var double, xent double, is_pad boolean",
    )


def test_detectors_from_logits(spark):
    # Softmax of logs gives back the distributions.
    one, two = [0.5, 0.25, 0.125, 0.125], [0.25] * 4
    df = spark.createDataFrame(
        [(1, "m", 0, 3, [math.log(p) for p in one]), (1, "m", 1, 0, [math.log(p) for p in two]), (1, "m", 2, 2, two)],
        "sample_id long, model string, pos int, token_id int, logits array<float>",
    ).withColumn("is_pad", F.lit(False))
    wanted = {n: d for n, d in det.detectors().items() if not d.needs_pair}
    found = {r.Detector: r.Value for r in det.score(det.statistics_from_logits(det.shift_labels(df)), wanted).collect()}
    assert found["loglikelihood"] == pytest.approx(-(math.log(2) + math.log(4)) / 2, abs=1e-6)
    assert found["entropy"] == pytest.approx((1.75 * math.log(2) + math.log(4)) / 2, abs=1e-6)
    assert found["rank"] == 1.0


def test_pair_detectors_on_uniform_distributions(spark):
    log4 = math.log(4)
    df = stats_rows(spark, [(1, "m", "m", 3, -log4, None, None, -log4, 0.0, log4, False)])
    pairs = {n: d for n, d in det.detectors().items() if d.needs_pair}
    found = {r.Detector: r.Value for r in det.score(df, pairs).collect()}
    assert math.isnan(found["fastdetectgpt"])
    assert found["binoculars"] == pytest.approx(1.0)


def test_pair_statistics_detect_other_tokens(spark):
    data = [(1, "a", 0, 1, False, [0.1, 0.2, 0.3]), (1, "b", 0, 2, False, [0.1, 0.2])]
    shifted = spark.createDataFrame(data, "sample_id long, model string, pos int, label int, label_pad boolean, logits array<float>")
    pairs = spark.createDataFrame([("a", "b")], "model string, model2 string")
    with pytest.raises(Exception, match="tokenize a sample differently"):
        det.pair_statistics_from_logits(shifted, pairs).collect()
    assert det.pair_statistics_from_logits(shifted, pairs, on_mismatch="drop").count() == 0


def test_pair_statistics_cut_the_vocabulary(spark):
    data = [(1, "a", 0, 1, False, [0.0, 0.0, 9.0]), (1, "b", 0, 1, False, [0.0, 0.0])]
    shifted = spark.createDataFrame(data, "sample_id long, model string, pos int, label int, label_pad boolean, logits array<float>")
    pairs = spark.createDataFrame([("a", "b")], "model string, model2 string")
    row = det.pair_statistics_from_logits(shifted, pairs).first()
    assert row.logprob == pytest.approx(-math.log(2)) and row.mu == pytest.approx(-math.log(2)) and row["var"] == 0


def test_padding_is_masked(spark):
    df = stats_rows(spark, [(1, "m", None, 1, -1.0, 0.5, 1.0, None, None, None, False), (1, "m", None, 1, -9.0, 0.5, 3.0, None, None, None, True)])
    found = {r.Detector: r.Value for r in det.score(df, {n: d for n, d in det.detectors().items() if not d.needs_pair}).collect()}
    assert found == {"loglikelihood": -1.0, "entropy": 0.5, "rank": 2.0}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_languages(spark):
    canon = [value(spark, lang.canonical_language(F.lit(x))) for x in ("C++", None, "python2", "cs", "c#", "c++")]
    assert canon == ["generic", "generic", "python", "csharp", "csharp", "cpp"]


@pytest.mark.parametrize(
    "language, text, documentation, expected",
    [
        ("python", "a", False, "#a"),
        ("python", "a\nb", False, '"""\na\nb\n"""'),
        ("go", "a", True, "//a"),
        ("js", "a\nb", False, "/*\na\nb\n*/"),
        ("rust", "a\nb", True, "///a\n///b"),
        ("java", "a\r\nb\n", True, "///a\r\n///b\n"),
        ("csharp", "", True, "///"),
    ],
)
def test_comments(spark, language, text, documentation, expected):
    assert value(spark, lang.to_comment(F.lit(language), F.lit(text), documentation)) == expected


def test_prompts(spark):
    prompt = lambda form, tag: value(spark, tx.prompt_by_format(F.lit(form), F.lit(tag), F.lit("sort")))
    assert prompt("doc_comment", "rust") == "///sort\n"
    assert prompt("language_comment", "python") == "# language: python\n# sort\n"
    assert prompt("named_language_comment", "generic") == "// sort\n"
    assert prompt("instruction", "cpp").startswith("In C++, write some code with the following functionality: sort.\n\n")
    assert prompt("unknown", "cpp") is None


@pytest.mark.parametrize(
    "output, code",
    [
        ("x ```python\ncode\n``` y", "code"),
        ("```c++\na\n```\nand\n```\nb\n```", "c++\na\n```\nand\n```\nb"),
        ("\\begin{code}z\\end{code}", "z"),
        ("```\nopen end", "open end"),
        ("plain", "plain"),
    ],
)
def test_clean_output(spark, output, code):
    # The fence's language may hold letters and | + only; + counts, digits do not.
    expected = code if not output.startswith("```c++") else "a\n```\nand\n```\nb"
    assert value(spark, tx.clean_output(F.lit(output))) == expected


def test_first_fence_is_lazy(spark):
    text = "```py\na\n``` and ```\nb\n```"
    assert value(spark, tx.extract_fenced(F.lit(text))) == "a"
    assert value(spark, tx.extract_fenced(F.lit("none"))) is None


def test_dates(spark):
    assert value(spark, tx.problem_epoch(F.lit(2343))) == tx.calendar_epoch(2022, 6, 24)
    assert value(spark, tx.problem_epoch(F.lit(2342))) == tx.calendar_epoch(2022, 6, 23)
    df = spark.createDataFrame([(tx.calendar_epoch(2020, 1, 1),)], "Date long")
    assert flt.after_date((2020, 1, 1))(df).count() == 0
    assert flt.before_date((2020, 1, 1))(df).count() == 0


def test_length_range(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in range(1, 13)], "Code string")
    kept = flt.length(range(2, 10, 3))(df).collect()
    assert sorted(len(r.Code.split()) for r in kept) == [2, 5, 8]


def test_budget(spark):
    budget = lambda *a: value(spark, tx.output_budget(*[F.lit(x) for x in a]))
    assert budget(2048, 100) == 256
    assert budget(2048, 100, 1000) == 1250
    assert budget(2048, 100, 10) == 256
    assert budget(2048, 5000) == 1


def test_sample_hash(spark):
    import hashlib

    text = (
        "PL: python\nCode: x\n\n\nDataset: d\nGenerator: human\nPrompt: p\nOriginal Prompt: o\nDate: 5\n"
        "Temperature: None\nTop-p: 0.95\nTop-k: None"
    )
    hashed = tx.sample_hash(*[F.lit(v) for v in ("python", "x", "d", "human", "p", "o", 5, None, 0.95, None)])
    assert value(spark, hashed) == hashlib.sha256(text.encode()).hexdigest()


def test_detection_rows_of_old_stores(spark):
    df = spark.createDataFrame([("[0.5]", "None", "1619222400.5")], "Value string, SecondaryModel string, Date string")
    row = normalise.normalise_detections(df).first()
    assert (row.Value, row.SecondaryModel, row.Date, row.MaxLength) == (0.5, None, 1619222400, None)


def test_informativeness(spark):
    found = value(spark, sc.informativeness(F.lit(0.1), F.lit(0.3)))
    assert found == pytest.approx(0.2 / math.sqrt(2) * math.sqrt(0.1))


def test_softmax_is_stable(spark):
    found = value(spark, pr.log_softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert found == pytest.approx([-math.log(2)] * 2)


def test_xml_lines_are_repaired_or_reported(spark):
    lines = ['<?xml version="1.0"?>', "<samples>", '  <sample Code="a\x01b" Prompt="p" />', '  <sample Code="ok" />', '  <sample Code="x', "</samples>"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.Code for r in stores.parse_lines(df).collect()) == ["a b", "ok"]
    assert [r.value for r in stores.broken_lines(df).collect()] == ['  <sample Code="x']


def test_unions_of_other_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        so.concatenate([spark.range(1), spark.range(1).selectExpr("string(id) as id")])


def test_nothing_supported_gives_no_rows(spark):
    samples = spark.createDataFrame([(1, "python")], "sample_id long, Language string")
    capability = spark.createDataFrame([("m", "go")], "model string, Language string")
    assert flt.supported(samples, capability).count() == 0
    assert flt.unsupported(samples, capability, ["m"]).count() == 1


def test_greedy_paths_end_without_successor(spark):
    counts = spark.createDataFrame(
        [("m", "a", "b", 2), ("m", "a", "c", 1), ("m", "b", "c", 1), ("m", "x", "x", 1)], "model string, ctx string, token string, c long"
    )
    paths = {r.ctx: r.tokens for r in gen.greedy_continuations(counts, 4).collect()}
    assert paths == {"a": ["b", "c"], "b": ["c"], "x": ["x"] * 4}
