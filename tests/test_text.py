"""Hand-computed edges of the text and rule functions."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from kbspark.functions import rules as R
from kbspark.functions import text as X
from kbspark.functions import urls as U


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def windows(text, size=500, overlap=80):
    """Plain statement of the chunk rule."""
    text = text.strip()
    cut = (text[p:p + size].strip() for p in range(0, len(text), size - overlap))
    return [c for c in cut if c]


@pytest.mark.parametrize("overlap", [0, 80, 300])
def test_chunks_follow_the_window_rule(spark, overlap):
    texts = ["x" * n for n in (1, 80, 420, 421, 500, 501, 999)] + ["", "  ", "a" * 400 + " " * 600 + "é" * 500, "p\n" * 700]
    got = values(spark, texts, lambda c: X.chunk_texts(c, 500, overlap))
    assert got == [windows(t, 500, overlap) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n  é😀", max_size=90), min_size=1, max_size=8))
def test_chunks_and_strip_agree_with_python(spark, texts):
    assert values(spark, texts, lambda c: X.chunk_texts(c, 20, 5)) == [windows(t, 20, 5) for t in texts]
    assert values(spark, texts, X.strip) == [t.strip() for t in texts]


def test_header_round_trip(spark):
    row = spark.range(1).select(X.parse_chunk(F.lit("[SOURCE:KB] [FILE:a b.txt] [CHUNK:3]\nline\nmore")).alias("p")).select("p.*").first()
    assert tuple(row) == ("KB", "a b.txt", 3, "line\nmore")
    assert values(spark, ["[SOURCE:KB] [FILE:x.txt] [CHUNK:0]", "none"], X.header_file) == [["x.txt"], []]


def test_kb_clean(spark):
    texts = ["a\r\nb\r\rc\n\n\n\nd", "x  \t y", "keep\nALL RIGHTS reserved 2024\nend", "page 3 of 9 text", "a------b", "a copyright x y\nz"]
    got = values(spark, texts, X.kb_clean)
    assert got[:5] == ["a\nb\n\nc\n\nd", "x y", "keep\n\nend", "text", "ab"]
    assert got[5] == "a \nz"   # '.' runs over every separator but the line feed


def test_kb_reject_reason(spark):
    got = values(spark, ["", "short", "é" * 120, "word " * 40], lambda c: X.kb_reject_reason(c, X.kb_clean(c)))
    assert got == ["empty", "too_short", "no_tokens", None]


def test_email_clean(spark):
    texts = [
        "Hello\n> quoted\nbye",
        "Hi\nOn Mon, Bob wrote:\nrest",
        "Body\n--\nSig\nmore",
        "Body\nBest regards,\nBob",
        "Go To: the shop\nnext",
        "x\nThis email is\nconfidential ok\ny",
    ]
    assert values(spark, texts, X.email_clean) == ["Hello\n\nbye", "Hi\n\nrest", "Body", "Body", "Go \nnext", "x"]


def test_masks(spark):
    texts = ["mail a.b@c.org now", "call +91 98765 43210", "card 4111 1111 1111 1111", "see www.x.org/a", "id 1234567 AB-123", "k" * 25]
    assert values(spark, texts, X.mask_pii) == [
        "mail [EMAIL] now", "call [PHONE]", "card [CARD]", "see [URL]", "id [ID] [ID]", "[TOKEN]"]
    assert values(spark, ["n 1234567 x"], lambda c: X.mask_pii(c, "relaxed")) == ["n 1234567 x"]
    assert len(values(spark, ["w " * 400], X.mask_pii)[0]) <= 500


def test_model_output_paths(spark):
    texts = [
        '{"summary": " s ", "key_details": ["a", " ", "b"]}',
        'Sure {"summary": "s", "key_details": []} and {"x": 1}',
        "First\n- one\n• two\n3) three",
        '{"summary": "", "key_details": []}',
        '{"summary": "s", "key_details": "no list"}',
        '{"a": {"b": "}"}, "summary": "s"}',
        "{broken",
    ]
    got = [(r["summary"], r["key_details"], r["parse_path"], r["is_valid"]) for r in values(spark, texts, X.parse_model_output)]
    assert got == [
        ("s", ["a", "b"], "json", True),
        ("s", [], "block", True),
        ("First", ["one", "two", ") three"], "lines", True),
        ("", [], "json", False),
        ("s", [], "json", False),
        ("s", [], "json", True),
        ("{broken", [], "lines", True),
    ]


def test_policy_text(spark):
    doc = json.dumps({"refund_window": 30, "don't_2nd": ["a", None], "x": None, "y": True})
    assert values(spark, [doc], X.policy_text) == ["Refund Window: 30\nDon'T 2Nd:\n- a\n- None\nX: None\nY: True"]


def test_html_text(spark):
    page = "<!DOCTYPE html><p a='>'>A &amp; B&#33; &#x41;&eacute;&amp</p> <p>\n  <!-- c --><script>var x='<p>'</script>end"
    assert values(spark, [page], X.html_text) == ["A & B! Aé&\n \n\n\nend"]


def test_file_names(spark):
    names = ["a/b/..Été  (1).TXT", "x.tar.gz", ".hidden", "noext", "a..b.pdf"]
    assert values(spark, names, X.safe_file_name) == ["_t_1_.txt", "x.tar.gz", ".hidden", "noext", "ab.pdf"]
    assert values(spark, names, X.file_extension) == [".txt", ".gz", "", "", ".pdf"]
    assert values(spark, ["x.tar.gz", "noext"], X.file_stem) == ["x.tar", "noext"]


def test_meaningful(spark):
    texts = ["", "abc12", "aabbcc", "abcdef", "!!!!!!", "a1 b2 c3 d4", "ééééabc", None]
    assert values(spark, texts, R.meaningful_text) == [False, False, False, True, False, True, True, False]


def test_keyword_order_and_substrings(spark):
    assert values(spark, ["an ISSUE", "bank and legal", "fine"], R.keyword_hit) == ["sue", "legal", None]
    assert values(spark, ["an issue"], lambda c: R.keyword_hit(c, whole_words=True)) == [None]


def test_escalation_boundaries(spark):
    rows = spark.createDataFrame([
        (1, False, "complaint", 0.35, 0.55, "ok"), (2, False, "complaint", 0.3499, 0.1, "ok"),
        (3, False, "x", 0.5, 0.5501, "ok"), (4, False, "x", 0.5, None, "ok"),
        (5, True, "complaint", 0.9, 0.1, "ok"), (6, True, "x", 0.9, 0.1, "my Lawyer"), (7, False, "x", 0.9, 0.1, "my lawyer"),
    ], "i int, hard boolean, intent string, c double, d double, t string")
    why = R.escalation_reason(*map(F.col, ("hard", "intent", "c", "d", "t")))
    got = [(r["w"] or "").split(" ")[0] for r in rows.select("i", why.alias("w")).orderBy("i").collect()]
    assert got == ["", "retrieval_confidence", "best_distance", "best_distance", "hard_intent:", "keyword:", ""]


def test_url_rules(spark):
    urls = ["http://10.0.0.1/", "https://example.com/x", "ftp://example.com", "http://[::1]/", "http://evilacme.com", "HTTP://EXAMPLE.com:80",
            "http://172.31.0.1", "http://172.32.0.1", "http://user@127.0.0.1:9/", "nonsense", "http://010.1.1.1", "http://[2606:4700::1]/"]
    assert values(spark, urls, U.is_safe_url) == [False, True, False, False, True, True, False, True, False, False, True, True]
    assert values(spark, urls[4:6], lambda c: U.is_safe_url(c, ["acme.com"])) == [True, False]


def test_feedback_and_truthy(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 5, 6)], "r int").filter(F.col("r").between(1, 5))
    got = {r["r"]: r["b"] for r in rows.select("r", R.feedback_bucket(F.col("r")).alias("b")).collect()}
    assert got == {1: "needs_review", 3: "neutral", 4: "positive", 5: "positive"}
    assert values(spark, ["TRUE", "1", "Yes", "on", None], R.truthy) == [True, True, True, False, False]
