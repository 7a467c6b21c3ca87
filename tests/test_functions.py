"""SQL functions and the pandas adapter."""

import pytest

from vecscore import api
from vecscore.operators import embed
from vecscore.sources import providers


def test_sql_functions(spark):
    assert "cosine_distance" in api.register_functions(spark)
    row = spark.sql("SELECT cosine_distance(array(1D, 0D), array(0D, 1D)) AS a, cosine_similarity(array(1D, 0D), array(-1D, 0D)) AS b, cosine_distance(array(0D, 0D), array(1D, 0D)) AS c, relevance_score(2D, 1D) AS d, strip_tags('<p>a</p>  <b>b') AS e").first()
    assert row["a"] == 1 and row["b"] == -1 and row["c"] is None and row["d"] == pytest.approx(0.1353352832366127) and row["e"] == "a b"


def test_pandas_preprocessor(spark, tmp_path):
    def upper(frame, mark=""):
        text = frame["title"].str.upper() + mark
        return frame.assign(text=text, text_hash=text.str.len().astype(str), lang="en")[["id", "text", "text_hash", "lang"]]

    df = spark.createDataFrame([("1", "ab", None), ("2", "abc", None)], "id string, title string, abstract string")
    got = embed.prepare_rows(df, api.pandas_preprocessor(upper, "lang string"), {"mark": "!"})
    assert sorted(map(tuple, got.collect())) == [("1", "AB!", "3", "en"), ("2", "ABC!", "4", "en")]
    (tmp_path / "p").mkdir()
    df.write.parquet(str(tmp_path / "p/corpus"))
    out = api.embed_corpus(spark, str(tmp_path / "p"), providers.backend_config("local"), text_preprocessor=api.pandas_preprocessor(upper, "lang string"))
    assert out["embedded_rows"] == 2
