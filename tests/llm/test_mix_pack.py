"""Mixing, packing, URL filters and toxicity: totals, round trips, held-out accuracy."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from vecscore.llm import mixing, packing, toxicity, urls
from vecscore.llm.queries import tokenizer_files


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing the excess again until none is above."""
    total, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * weights[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def corpus(spark, n=3000):
    rng = np.random.default_rng(5)
    data = [(int(k), " ".join(["w"] * int(rng.lognormal(3, 1))), ["b", "a", None, "c", "e", "d", "big"][k % 7] if k % 3 else "big") for k in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.mark.parametrize("block", [4096, 64])
def test_mix_meets_its_targets(spark, block, monkeypatch):
    data, df = corpus(spark)
    sample = mixing.cube_sample
    monkeypatch.setattr(mixing, "cube_sample", lambda units: sample(units, block))
    got = mixing.mix(df).toPandas()
    assert len(got) == len(data) and got["copies"].between(0, 2).all()
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)})
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s in names:
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want[s]) and own["source_size"].iloc[0] == sizes[s]
        assert abs((own["copies"] * own["size"]).sum() - want[s]) <= max(3, 0.002 * want[s])
        assert abs(own["copies"].sum() - len(own) * want[s] / sizes[s]) <= 4
    again = mixing.mix(df.repartition(5)).toPandas()
    assert got.set_index("doc_id")["copies"].sort_index().tolist() == again.set_index("doc_id")["copies"].sort_index().tolist()


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 500):
        p, size = rng.random(n), rng.integers(0, 5, n).astype(float)
        before = p.sum(), (p * size).sum()
        mixing.flight(p, size, rng.random(n))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert (p.sum(), (p * size).sum()) == pytest.approx(before, abs=1e-6)


def test_flight_keeps_each_probability():
    """Over many draws every document is taken as often as its probability says: moves are balanced, not biased."""
    p0, size = np.array([0.2, 0.7, 0.4, 0.55, 0.9, 0.35]), np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0])
    rng, total = np.random.default_rng(3), np.zeros(6)
    for _ in range(4000):
        p = p0.copy()
        mixing.flight(p, size, rng.random(20))
        total += p
    assert np.abs(total / 4000 - p0).max() < 0.03


def test_landing_is_the_best_of_all_choices():
    import itertools

    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        p, size = rng.random(n), rng.integers(1, 50, n).astype(float)
        words, rows_ = float((p * size).sum()), float(p.sum())
        able = [c for c in itertools.product([0, 1], repeat=n) if abs(sum(c) - rows_) < 1.5]
        best = min(abs(np.dot(c, size) - words) for c in able)
        mixing.land(p, size)
        assert set(p) <= {0.0, 1.0} and abs(p.sum() - rows_) < 1.5 and abs(p @ size - words) == pytest.approx(best)


def test_mix_of_odd_tables(spark, odd, none):
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count()
    out = mixing.repeated(odd, mixed)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert mixing.mix(none).count() == 0


def test_packing_is_a_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    slow = Tokenizer.from_file(files["vocabulary"])
    docs = [(k, r[1]) for k, r in enumerate(rows())] + [(60 + k, t) for k, t in enumerate(["x <|endoftext|> y", "日本語 текст", "a b c\x1c d", "ǅ ſ ﬁ", "tab\t\ttab\n\n\n end   ", "don't I'll 12345 !!??"])]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), **files, keep_ids=True).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in docs:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 2048 for r in own[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
        total += len(ids)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 2
    assert packing.pack_documents(odd, **files).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack_documents(none, **files).count() == 0


def test_urls_against_plain_rules(spark):
    given = ["http://Example.com/en/7", "https://a.example.com/en/8", "http://notexample.com/en/1", "http://com/en/x", "http://b.net/de/8", "http://x.example.net/de/8?q", "http://example.net/de/9#f", "http://es.org/es/", "http://org/es", "http://a.org/x.com/en/", "http://a.fr/login", "http://a.fr/", "http://a.fr/x.exe?y", "no scheme", "", None, "://", "http://a.com\x01/en/"]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(given)] + [(0, given[0], "x", "y")], "page_id long, url string, host string, rule string")
    got = urls.url_filter(df).collect()
    assert len(got) == len(given) + 1
    for r in got:
        host, path, _ = urls.parts_of(given[r["page_id"]])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if not host or "login" in path or path.endswith(".exe") else "allow")
    assert urls.url_filter(df.limit(0)).count() == 0
    long_ = spark.createDataFrame([(1, "http://a.fr/" + "x" * 200_000 + "/login"), (2, "http://" + "y" * 100_000 + ".org/es/"), (3, None)], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.url_filter(long_).orderBy("page_id").collect()] == [(None, "block"), ("org/es/", "block"), (None, "block")]


def brute_best(s):
    """The best segment's score, by all pairs."""
    sums = np.concatenate([[0], np.cumsum(s)])
    return max(sums[j] - sums[i] for i in range(len(sums)) for j in range(i + 1, len(sums)))


def test_segments_are_maximal_and_disjoint():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 200):
        s = rng.normal(-0.3, 1, n)
        found = toxicity.maximal_segments(s)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        for a, b, score in found:
            own = s[a:b]
            assert score == pytest.approx(own.sum()) and score > 0
            head = np.cumsum(own)
            assert (head > -1e-9).all() and head.max() <= score + 1e-9  # no better piece begins or ends inside
        if (s > 0).any():
            assert max(x for *_, x in found) == pytest.approx(brute_best(s))


def test_isotonic():
    p = toxicity.isotonic(np.array([1.0, 0, 3, 0, 9]), np.array([1.0, 1, 1, 2, 1]))
    assert (np.diff(p) >= 0).all() and p[-1] == 0.9 and p[0] == pytest.approx(1 / 3)


def test_toxic_documents_are_found(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["score"].between(0, 1)).all()
    sure = got[got["predicted"] == 1]
    assert len(sure) >= 5 and (sure["toxic"] == 1).mean() >= 0.8
    assert ((got["toxic"] == 0) & (got["predicted"] == 1)).sum() <= 2
    few = labels.limit(0)
    assert toxicity.toxicity(odd, few).select("score").distinct().collect()[0]["score"] == 0
    assert toxicity.toxicity(none, few).count() == 0 and toxicity.toxicity(odd, labels).count() == odd.count()


def test_passages_are_told(spark):
    model = toxicity.ToxicModel(weights={"awful": 6.0, "horri*": 5.0}, other=-0.3, lam=1.0, k=0.1, expect=0.05)
    df = spark.createDataFrame([(1, "nice words " * 30 + "You AWFUL, horrible thing " + "nice words " * 30), (2, "nice"), (3, None)], "doc_id long, text string")
    found = toxicity.toxic_passages(df, model).collect()
    assert [(r["doc_id"], r["first_word"], r["end_word"], r["words"]) for r in found] == [(1, 61, 63, "awful horrible")]


def test_texts_are_joined_once_unless_rows_are_alike(spark):
    plain = [(k, f"text {k}") for k in range(6)]
    taken = {0: 0, 1: 1, 2: 2, 3: 1, 4: 0, 5: 2}
    for rows, joins in ((plain, 1), ([*plain, (2, "text 2")], 2)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        mixed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.element_at(F.create_map(*[F.lit(x).cast("long") for p in taken.items() for x in p]), F.col("doc_id")).alias("copies"))
        mixed = mixed.withColumn("copies", F.when((F.col("doc_id") == 2) & F.lit(joins == 2), 1).otherwise(F.col("copies")))  # two rows of it, one copy each
        found = mixing.repeated(docs, mixed)
        assert found._jdf.queryExecution().analyzed().toString().count("Join") == joins
        assert sorted(r["doc_id"] for r in found.collect()) == [1, 2, 2, 3, 5, 5]
