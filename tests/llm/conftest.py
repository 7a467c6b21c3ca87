"""Tables with everything odd in them: nulls, empty and long texts, repeats, ties, clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, h long, _id long, kept string, rows int, fp long"
LINES = [
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "the quick brown fox jumps over the lazy cat near the old river bank today",
    "The quick brown fox jumps over the lazy dog near the very old river bank today",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "short line",
    "Übung macht den Meister und noch mehr Wörter stehen in dieser Zeile hier",
]


def rows():
    texts = [
        "\n".join(LINES[:2] + LINES[3:4]), "\n".join([LINES[0], "", LINES[2], LINES[5]]), LINES[6] + "\n" + LINES[4], None, "", "   \n\t", "one two", "\n".join(LINES[:1] * 4),
        " ".join(f"w{k % 977} x{k % 13}" for k in range(20_000)), " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)), LINES[5] + "\n" + " ".join(f"v{k}" for k in range(40)),
        "gnu general public license and cc by cc by mit license", "A\x00b   c d 名前 <|im_end|> ok",
    ]
    out = [(k, t, "en", None if k % 5 == 4 else f"s{k % 3}", k, "r", "i", 1, 2, "k", 3, 4) for k, t in enumerate(texts)]
    out += [(None, "no id here", None, "s0", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return out + [out[0], out[9]]  # repeated rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
