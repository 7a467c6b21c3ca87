"""SimHash groups, line dedup and exact fingerprints against plain Python."""

import hashlib
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from vecscore.llm import digest, graph, lines, simhash
from vecscore.llm.graph import components


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)} | {201: 200}
    assert got == want


def hot_conf(spark):
    """Settings with which no table is broadcast and a partition of a few dozen kB counts as skewed."""
    return {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}


@contextmanager
def settings(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hub_of_the_graph_is_split(spark):
    with settings(spark, hot_conf(spark)):
        edges = spark.range(30_000).selectExpr("id % 7919 * 1000003 AS u", "IF(id < 20000, -5, id * 31) AS v")
        both = lines.materialise(edges.unionByName(edges.selectExpr("v AS u", "u AS v")).repartition(16), "both")
        least = lines.materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = graph._with_least(both, least)
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def brute_components(docs, words=4, bits=4):
    fp = [simhash.fingerprint(None if t is None else t.encode(), words) for _, t in docs]
    v = np.array(fp, dtype=np.uint64)
    i, j = np.triu_indices(len(v), 1)
    ok = np.bitwise_count(v[i] ^ v[j]) <= bits
    label = simhash.trees(len(v), i[ok], j[ok])
    least = {}
    for k, (doc, _) in enumerate(docs):
        if doc is not None:
            least[label[k]] = min(least.get(label[k], doc), doc)
    return sorted(((d, f"{f:016x}", least.get(label[k])) for k, ((d, _), f) in enumerate(zip(docs, fp, strict=True))), key=str)


def near_copies(n=60):
    base = [f"t{k * 7919 % 1013}" for k in range(400)]
    out = []
    for k in range(n):
        w = base.copy()
        for j in range(k % 5):
            w[(k * 31 + j * 97) % 400] = f"edit{k}{j}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_groups_are_those_of_all_pairs(spark, odd, none):
    docs = [(r[0], r[1]) for r in rows()] + near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute_components(docs)
    assert simhash.near_duplicates(none).count() == 0
    stays = simhash.one_of_each(odd, simhash.near_duplicates(odd, words=5))
    assert stays.columns == odd.columns
    want = {c for _, _, c in brute_components([(r[0], r[1]) for r in rows()], 5)}
    assert sorted((r["doc_id"] for r in stays.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("m", [5, 6])
def test_large_tries_are_dealt_in_blocks(spark, m):
    docs = near_copies(80)
    fp = sorted({simhash.fingerprint(t.encode()) for _, t in docs})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    edges = simhash.links(nodes, block=3, m=m)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    v = np.array(fp, dtype=np.uint64)
    i, j = np.triu_indices(len(v), 1)
    ok = np.bitwise_count(v[i] ^ v[j]) <= 4
    label = simhash.trees(len(v), i[ok], j[ok])
    signed = v.view(np.int64)
    groups = defaultdict(set)
    for k, x in enumerate(signed):
        groups[label[k]].add(int(x))
    for own in groups.values():
        assert {roots.get(x, x) for x in own} == {min(own)}


def near(a, b):
    if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:p] + a[p + 1 :] == b for p in range(len(a)))


def brute_lines(docs):
    order = sorted({(i if i is not None else -1, t or "") for i, t in docs})
    first = {}
    for i, t in order:
        for k, line in enumerate(t.encode().split(b"\n")):
            if w := tuple(line.lower().split()):
                first.setdefault(w, (i, t, k))
    gone = {a for a in first for b in first if a != b and first[b] < first[a] and near(a, b)}
    out = []
    for i, t in docs:
        keep, n, removed = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().lower().split())
            if not w:
                keep.append(line)
                continue
            n += 1
            if first[w] == (i if i is not None else -1, t, k) and w not in gone:
                keep.append(line)
            else:
                removed += 1
        out.append((i, n, removed, t if not removed else "\n".join(keep) if removed < n else ""))
    return sorted(out, key=str)


def edited_lines(n=30):
    out = []
    for k in range(n):
        w = [f"a{j}" for j in range(8 + k % 10)]
        w[k % len(w)] = f"e{k % 4}" if k % 3 else "same same"
        out.append((500 + k, " ".join(w) + "\n" + " ".join(w[: 8 + k % 3]) + "\nown " + str(k)))
    return out


def test_lines_are_those_of_all_pairs(spark):
    docs = [(r[0], r[1]) for r in rows()] + edited_lines()
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(docs)


def test_hot_lines_and_keys_are_split(spark):
    """With no table broadcast, the joins on the line that thousands share a deletion with are dealt out again at run time."""
    docs = [(k, f"page {k} of the annual report on the state of the woods") for k in range(20_000)]
    docs += [(100_000 + k, " ".join(f"own{k}w{j}" for j in range(9))) for k in range(2_000)]
    with settings(spark, hot_conf(spark)):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(64)
        classes = lines.materialise(lines.line_classes(df), "classes")
        rows = lines._variant_rows(lines._texts_of(lines.open_lines(classes, 5), df, "doc_id", "text"))
        rows = lines.materialise(rows.repartition(16), "rows")  # a key can be split by the files that it comes from
        earliest = lines.materialise(rows.filter("at >= 0").groupBy("k", "at").agg(F.min(F.struct("id", "dg", "pos", "h1", "h2")).alias("e")), "earliest")
        joined = rows.filter("at >= 0").join(earliest, ["k", "at"])
        assert len(joined.collect()) == rows.filter("at >= 0").count()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        got = lines.dedup_lines(df)
        assert got.filter("n_removed = 0").count() == 1 + 2_000


def test_line_dedup_keeps_columns(spark, odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    assert [r["row"] for r in out.filter("doc_id = 1").collect()] == ["r"]
    assert lines.dedup_lines(none).count() == 0


def brute_fingerprints(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        same = digest.canonical(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest.digest(same), digest.digest(digest.canonical(edited)), float(same == digest.canonical(edited)), float(same == digest.canonical(after))))
    return out


@pytest.mark.parametrize("target_rows", [100, 3, 1])
def test_fingerprints_and_next_documents(spark, target_rows):
    docs = [(k, t) for k, t in enumerate([r[1] for r in rows()])] + [(90, "Ｆｕｌｌ  WIDTH"), (91, "full width"), (92, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = digest.document_fingerprints(df, target_rows).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute_fingerprints(docs))
    classes = defaultdict(list)
    for i, t in docs:
        classes[digest.canonical(t)].append(i)
    assert {r["doc_id"]: (r["class_id"], r["copies"]) for r in got} == {i: (min(own), len(own)) for own in classes.values() for i in own}


def test_fingerprints_of_odd_tables(spark, odd, none):
    assert digest.document_fingerprints(odd).count() == odd.count()
    assert digest.document_fingerprints(none).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert digest.document_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_repeated_and_null_ids_are_cut_into_ranges(spark):
    docs = [(None, f"null {k}") for k in range(40)] + [(7, f"seven {k}") for k in range(40)] + [(7, "seven 3")] * 3 + [(9, "last")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marked = digest._marked(df, "doc_id", "text")
    cuts = digest._ranges(marked, 5)
    assert len({c for c in cuts if c[0] == 7}) >= 4 and len({c for c in cuts if c[0] < 0}) >= 4
    order = sorted(docs, key=lambda d: (-1 if d[0] is None else d[0], digest.xxhash.xxh64_intdigest(d[1].encode()) >> 1))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest.digest(digest.canonical(t))))
    for target in (5, 100):
        assert sorted((tuple(r)[:4] for r in digest.document_fingerprints(df, target).collect()), key=str) == sorted(want, key=str)


def test_edited_texts_of_a_mixed_bucket(spark):
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sha string, edited_sha string, zip binary"
    rows_ = spark.createDataFrame([(1, 1, "", "f", "g", 0.0, 0.0, "a" * 64, "c" * 64, b"a"), (2, 1, "", "f", "f", 0.0, 0.0, "b" * 64, "a" * 64, b"b"), (3, 1, "", "g", "h", 0.0, 0.0, None, "d" * 64, None)], columns)
    groups = digest.byte_groups(rows_.filter("zip IS NOT NULL").select("doc_id", "fingerprint", F.col("zip").alias("canon"), "sha"))
    got = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"]) for r in digest._named(rows_, groups).collect()}
    assert got == {1: ("f-" + "a" * 32, "g"), 2: ("f-" + "b" * 32, "f-" + "a" * 32), 3: ("g", "h")}  # 2's edited text is 1's text


def test_unequal_bytes_in_one_bucket(spark):
    rows_ = spark.createDataFrame([(1, "f", b"a"), (2, "f", b"b"), (3, "f", b"a"), (4, "g", b"c")], "doc_id long, fingerprint string, canon binary")
    got = {(r["fingerprint"], r["class_id"]): (r["copies"], r["suffix"] is not None) for r in digest.byte_groups(rows_).collect()}
    assert got == {("f", 1): (2, True), ("f", 2): (1, True), ("g", 4): (1, False)}
