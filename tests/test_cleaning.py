"""The cleaner: modes, policies, reasons, flags."""

import pytest

from vecscore import api
from vecscore.functions.hashing import xxh64_hex
from vecscore.operators import cleaning

LONG = "This abstract talks at length about rivers and their banks and about the fish that live in them all year round. " * 2


def clean(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, title string, abstract string")
    return {r["id"]: r for r in api.clean_abstract_for_embedding(df, **options).collect()}


def test_hash_is_seed_zero(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(xxh64_hex(F.col("t"))).collect()] == ["44bc2cf5ad770999", "ef46db3751d8e999", None]


def test_reasons(spark):
    rows = [
        ("a", "A good title here", LONG), ("b", "A good title here", None), ("c", "A good title here", "No abstract available"), ("d", "A good title here", "Copyright Elsevier all rights reserved"),
        ("e", "A good title here", "1234 5678 " * 30), ("f", "A good title here", "short but made of letters"), ("g", "", None), ("h", "Rivers", "RIVERS: " + LONG), ("i", "A good title", "<p>x</p> &nbsp; " + "words " * 10), (" j  k ", "T", LONG),
        ("l", "T", "See http://www.w3.org xmlns " + "word " * 20),
    ]
    got = clean(spark, rows, mode="balanced")
    assert {k: r["discard_reason"] for k, r in got.items()} == {
        "a": "", "b": "low_alpha_ratio", "c": "too_short", "d": "boilerplate_short", "e": "low_alpha_ratio", "f": "too_short", "g": "low_alpha_ratio", "h": "", "i": "html_artifact_short", "j k": "", "l": "html_artifact_short"}
    assert got["a"]["text"] == "Title: A good title here\nAbstract: " + LONG.strip() and got["a"]["abstract_kept"] and got["a"]["text_quality"] == "title_abstract"
    assert got["b"]["text"] == "Title: A good title here" and not got["b"]["abstract_raw_present"] and got["b"]["text_quality"] == "title_only"
    assert got["g"]["text"] == "Title: "
    assert got["h"]["text"] == "Title: Rivers\nAbstract: " + LONG.strip()


def test_modes_and_policies(spark):
    rows = [("a", "A good title here", "word " * 12), ("b", "Short", None), ("c", "A fine long title", None)]
    assert clean(spark, rows)["a"]["abstract_kept"] and clean(spark, rows)["a"]["cleaning_mode"] == "lenient"
    assert not clean(spark, rows, mode="strict")["a"]["abstract_kept"]
    assert set(clean(spark, rows, no_abstract_policy="discard")) == {"a"}
    assert set(clean(spark, rows, no_abstract_policy="conditional")) == {"a", "c"}
    assert clean(spark, rows, mode="strict", min_chars=10, min_alpha_ratio=0.1)["a"]["abstract_kept"]
    assert not clean(spark, rows, placeholder_patterns=["^word"])["a"]["abstract_kept"]
    df = spark.createDataFrame(rows, "id string, title string, abstract string")
    assert api.clean_abstract_for_embedding(df, return_flags=False).columns == ["id", "text", "text_hash"]
    with pytest.raises(ValueError, match="lacks .*abstract"):
        api.clean_abstract_for_embedding(df.drop("abstract"))
    with pytest.raises(ValueError, match="mode"):
        cleaning.CleanRules(mode="other")


def test_text_is_read_back(spark):
    df = spark.createDataFrame([("Title: a\nAbstract: b\nAbstract: c",), ("Title: only",), ("other",)], "text string")
    got = [(r["cleaned_title"], r["cleaned_abstract"]) for r in cleaning.parse_text(df).collect()]
    assert got == [("a", "b\nAbstract: c"), ("only", None), (None, None)]
