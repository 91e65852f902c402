from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from paperloom.functions import text as T

SAMPLE = (
    "arXiv:2301.01234v2 [cs.AI] 5 Jan 2023\n 12 \nThe repre-\nsentation of train- ing data’s “value” — ﬁnal α ≤ 3…\n\n\n\n"
    "See https://example.org/a?b=1 or me@x.org \\cite{abc} now.\n   1. Introduction\ncafé café naïve ☃ end"
)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


def plain_unicode(text):
    text = unicodedata.normalize("NFKC", text)
    from paperloom import settings as S

    for table in (S.SAME_LENGTH, S.LONGER):
        for old, new in table.items():
            text = text.replace(old, new)
    return text


def test_unicode(spark):
    assert one(spark, T.normalize_unicode, SAMPLE) == plain_unicode(SAMPLE)
    assert one(spark, T.normalize_unicode, "plain") == "plain"
    assert one(spark, T.normalize_unicode, None) is None


def test_artifacts(spark):
    out = one(spark, T.remove_artifacts, SAMPLE)
    assert "arXiv" not in out and "[URL]" in out and "[EMAIL]" in out and "cite" not in out
    assert not re.search(r"^\s*12\s*$", out, re.M)
    assert one(spark, T.remove_artifacts, "a $x$ b") == "a $x$ b"
    assert one(spark, lambda c: T.remove_artifacts(c, strict_math=True), "a $x$ b") == "a  [MATH]  b"
    assert one(spark, lambda c: T.remove_artifacts(c, captions=True), "Figure 1: a thing\nnext") == "\nnext"


def test_hyphenation(spark):
    assert one(spark, T.fix_hyphenation, "repre-\nsentation train- ing x1-\n2y") == "representation train- ing x1-\n2y"


def test_clean_text(spark):
    out = one(spark, T.clean_text, SAMPLE)
    assert "representation" in out and "train- ing" in out and "alpha <= " in out and "final" in out
    assert not re.search(r"\n{3,}", out) and out == out.strip()
    assert one(spark, T.clean_text, None) == "" and one(spark, T.clean_text, " \n\t ") == ""


def test_assess(spark):
    judge = lambda t: one(spark, lambda c: T.assess(F.coalesce(c, F.lit("")), c), t)
    assert judge(None)["issues"] == ["no_text"] and judge("  ")["issues"] == ["empty_text"]
    short = judge("Some clean little text of words.")
    assert short["issues"] == ["too_short"] and abs(short["score"] - 0.3) < 1e-9
    rep = judge("word " * 200)
    assert "excessive_repetition" in rep["issues"] and abs(rep["score"] - 0.6) < 1e-9
    gib = judge("a b c d e " * 150)
    assert "potential_gibberish" in gib["issues"]


def test_names(spark):
    ids = {"2301.12345v2.pdf": "2301.12345v2", "10.48550_arXiv.2301.12345.pdf": "2301.12345", "other.pdf": None}
    for name, want in ids.items():
        assert one(spark, T.arxiv_id_from_filename, name) == want
    assert one(spark, T.sanitize_filename, ' a<b>:"c/d ') == "a_b___c_d"


def test_stray_characters(spark):
    """Letters and digits of any script stay, in one class without a look behind."""
    assert "(?<" not in T.STRAY
    assert one(spark, T.remove_artifacts, "aß٣ 你☃é\u0301x😀_—z\x0b.") == "aß٣ 你 é x _ z\x0b."
