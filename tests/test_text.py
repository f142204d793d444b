"""Accent folding in any script, against decomposition character by character."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tarsia.functions import text
from tarsia.functions.text import HANGUL


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_strip_accents(spark):
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and c not in HANGUL]
    r = random.Random(1)
    texts = ["", "Điện thoại Đà Nẵng", "Příliš žluťoučký kůň", "ẹ́", "ﬁnale ½ № Ⅷ", *("".join(r.choices(known, k=40)) for _ in range(300))]
    texts += ["".join(known[i : i + 200]) for i in range(0, len(known), 200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.strip_accents(F.col("t")).alias("p")).collect()
    for row in got:
        assert row.p == plain(texts[row.i]), texts[row.i]
    assert spark.createDataFrame([(None,)], "t string").select(text.strip_accents(F.col("t"))).first()[0] is None


def test_search_text_folds_names(spark):
    names = {"Điện thoại Sàigòn": "đien thoai saigon", "Škoda Žižkov": "skoda zizkov", "Caffè à la crème": "caffe a la creme", "ｆｕｌｌ ｗｉｄｔｈ": "full width"}
    got = spark.createDataFrame([(k,) for k in names], "t string").select("t", text.search_text(F.col("t")).alias("s")).collect()
    for row in got:
        assert row.s == " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in names[row.t]).split())


def test_titles_resolve_whole_entities(spark):
    from tarsia.operators.extract import page_title

    said = {"a &amp;&amp; b&amp": "a && b&amp", "&amp;lt; &lt;b&gt;": "&lt; <b>", " x\n\t y ": "x y", "": None}
    rows = spark.createDataFrame([(f"<TITLE lang=de>{t}</title>", want) for t, want in said.items()] + [(None, None)], "html string, want string")
    assert all(r.got == r.want for r in rows.select("want", page_title(F.col("html")).alias("got")).collect())
