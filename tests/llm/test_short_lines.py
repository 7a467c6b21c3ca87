"""Line dedup below 8 words against all pairs."""

import itertools

import pytest

from vecscore.llm import lines


def short_near(a, b, least):
    if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:p] + a[p + 1 :] == b for p in range(len(a)))


@pytest.mark.parametrize("min_words", [2, 5, 7, 8, 12])
def test_lines_below_eight_words(spark, min_words):
    texts = []
    for n, k in itertools.product(range(1, 13), range(4)):
        w = [f"n{n // 4}w{j}" for j in range(n)]
        if k:
            w[(5 * k) % n] = f"e{n}{k}"
        texts.append(" ".join(w))
    texts.append("这一行没有空格")
    gone = {j for j in range(len(texts)) for i in range(j) if texts[i] == texts[j] or short_near(texts[i].split(), texts[j].split(), min_words)}
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=min_words)
    assert {r["doc_id"] for r in got.filter("n_removed = 1").collect()} == gone
