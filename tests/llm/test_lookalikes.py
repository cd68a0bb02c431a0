import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairnset.llm import lookalikes as L

SAME = [
    ("naïve", "naïve"), ("return x", "ｒｅｔｕｒｎ　ｘ"), ("a b", "a b", "a b", "a b"), ("zero", "ze​ro", "z﻿ero", "ze­ro", "ze‍ro", "‎zero"),
    ("cache", "саche", "cаche"), ("file flow off", "ﬁle ﬂow oﬀ"), ("re-index", "re‐index", "re‑index"), ("べき", "べき"),
    ("ガラス", "ｶﾞﾗｽ"), ("x\ny", "x\r\ny", "x\ry"), ("Kelvin", "Kelvin"), ("ë", "ё"), ("ó", "ό"), ("\U0001d41bold", "bold"), ("é", "é", "é"), ("", "​", "﻿‎"),
    ("\U0001f469‍\U0001f469‍\U0001f467",), ("\U0001f469\U0001f469\U0001f467",), ("x²",), ("x2",), ("The",), ("the",), ("l",), ("1",), ("résumé",), ("resume",), ("a\tb",), ("O",), ("0",),
    ("\u2f00", "\u4e00"), ("pa\u04cfm", "palm"), ("\u0251\u0261e", "age"), ("\u13aaB", "AB"), ("\ua4d0\ua4f3B", "BOB"), ("p\u2044q", "p\u2215q"), ("x\u3164y", "xy", "x\uffa0y"),
    ("\u3131", "\u1100", "\uffa1"), ("\u3131\u314f", "\uffa1\uffc2"), ("\uac00", "\u1100\u1161"), ("\u21165", "No5"), ("wait\u2026", "wait..."), ("5\u338f", "5kg"), ("\u00bd", "1\u20442"),
    ("\u017f",), ("s",), ("\u2460",), ("\u03d1",), ("\u03b8",), ("\u00b4",), ("\ufe50 \u3010", ", \u3010")]


def folded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.canonical for r in L.fold_texts(df, "text", ["doc_id"]).collect()}


def test_same_looking_texts_have_one_form_and_others_do_not(spark):
    flat = [(k, t) for k, group in enumerate(SAME) for t in group]
    got = folded(spark, [t for _, t in flat])
    by_group = {}
    for i, (k, _) in enumerate(flat):
        by_group.setdefault(k, set()).add(got[i])
    assert all(len(forms) == 1 for forms in by_group.values()), {SAME[k]: f for k, f in by_group.items() if len(f) > 1}
    assert len({next(iter(f)) for f in by_group.values()}) == len(SAME)


def test_fixed_point_null_and_long_text(spark):
    texts = [t for g in SAME for t in g] + [None, "ｅ​" * 200_000]
    once = folded(spark, texts)
    assert folded(spark, [once[i] for i in range(len(texts))]) == once
    assert once[len(texts) - 2] is None and once[len(texts) - 1] == "e" * 200_000


def test_pairs_match_brute_force(spark):
    rows = [(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "k", "c"), (5, "m", "z"), (6, "m", "z"), (7, "n", "y")]
    lost = [(None, "k", "q"), (8, None, "q"), (9, "k", None)]
    df = spark.createDataFrame(rows + lost, "id long, class string, raw string")
    got = sorted(map(tuple, L.same_looking_pairs(df).collect()))
    assert got == [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] != b[2]]
    assert L.same_looking_pairs(df.limit(0)).count() == 0


def test_classes_have_counts_representatives_and_members(spark):
    rows = [(1, "k", "b"), (2, "k", "b"), (3, "k", "a"), (5, "m", "z"), (6, "m", "z"), (None, "k", "q"), (8, None, "q"), (9, "k", None)]
    classes, members = L.look_classes(spark.createDataFrame(rows, "id long, class string, raw string"))
    assert sorted(map(tuple, classes.collect())) == [("k", "a", "a", 1), ("k", "b", "a", 2)]
    assert sorted(map(tuple, members.collect())) == [(1, "k", "b"), (2, "k", "b"), (3, "k", "a")]


def test_clashing_column_is_refused(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, canonical string")
    with pytest.raises(ValueError):
        L.fold_texts(df, "text", ["doc_id", "canonical"])
    assert L.fold_texts(df, "text", ["doc_id", "canonical"], into="form").first().form == "x"
    assert L.fold_texts(df.select("text"), "text", ["text"]).first().canonical == "x"
