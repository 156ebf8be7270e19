"""The audit of filter interactions against a plain count of every document along every order."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from corpusdetect.llm import filteraudit

DOCS = "doc_id bigint, text string, source string, part string, mask int, n int, digest string, quality int, toxic int"
LABELS = "doc_id bigint, quality int, toxic int, part string, n int"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    def failing(i, r):
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = set()
        out |= {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        out |= {"D"} if re.search("[#$%&*|]", text) else set()
        if r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows):
            out.add("E")
        return out

    described = [
        (
            r[2] or "",
            failing(i, r),
            any(x[0] == r[0] is not None and x[1] == 1 for x in labels),
            any(x[0] == r[0] is not None and x[2] == 1 for x in labels),
        )
        for i, r in enumerate(rows)
    ]
    out = {}
    for part in {d[0] for d in described}:
        own = [d[1:] for d in described if d[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                here = [d for d in own if letter in d[0] and not d[0] & before]
                out[part, "".join(order), step + 1] = [
                    sum(1 for d in own if not d[0] & before and letter not in d[0]),
                    len(here),
                    sum(1 for d in own if letter in d[0] and d[0] & before),
                    sum(1 for d in own if d[0] == {letter}),
                    sum(d[1] for d in here),
                    sum(d[2] for d in here),
                ]
        for letter in "ABCDE":
            keys = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def test_awkward_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    texts = [None, "", " \t\n", "a", "A B", "x # y", "one two " * 150, "One two " * 150 + "|", long, long + " A",
             " ".join(f"Wort{i}é😀" for i in range(250)), " ".join(f"w{i}" for i in range(200)), "\x1c \x85 $"]
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 2}", "x", i, i, "d", 1, 1) for i, t in enumerate(texts)]
    rows += [(20 + i, t, "s1", "x", None, 1, "d", None, None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[20], (None, "", "", None, None, None, None, None, None), (None, long, None, *[None] * 6)]
    rows += [(3, "b", "s0", *[None] * 6), (-1, "one two " * 150, "s9", *[None] * 6)]
    labels = [(i, i % 2, i % 3 % 2, "p", 1) for i in range(0, 30)]
    labels += [(2, 1, None, None, None), (2, 1, 1, None, None), (None, 1, 1, None, None), (999, 1, 1, None, None), (5, None, None, None, None)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in filteraudit.audit(docs, marks).collect()}
    assert got == plain(rows, labels)
    assert filteraudit.audit(docs.limit(0), marks).count() == 0
    assert filteraudit.audit(docs, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, "a b", "s")], "doc_id int, text string, source string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id int, quality int, toxic int")
    rows = filteraudit.audit(docs, labels, {"X": F.col("text").contains("b")}, "Y").collect()
    got = {(r.filter_order, r.step, r.filter): [r[c] for c in COLUMNS] for r in rows}
    assert got == {
        ("XY", 1, "X"): [1, 2, 0, 1, 1, 0, 3], ("XY", 2, "Y"): [1, 0, 1, 0, 0, 0, 1],
        ("YX", 1, "Y"): [2, 1, 0, 0, 1, 0, 1], ("YX", 2, "X"): [1, 1, 1, 1, 0, 0, 3],
    }
