"""Every registered query that SQL can't express, as it is registered, against plain Python on the small tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_dedup import brute_components, brute_fingerprints
from tests.llm.test_mix_pack import fill
from vecscore.llm import mixing, packing, queries
from vecscore.llm.queries import tokenizer_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_op3(spark, docs):
    got = queries.op3_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components([d[:2] for d in docs])


def test_op6(spark, docs):
    """Every token once, in its place, in no more sequences than one above what the number of tokens asks for."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_files()["vocabulary"])
    by, seqs = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, SF).collect():
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t, _ in docs:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 2048 for r in own[1:])
        for k, r in enumerate(own):
            assert (r["piece"], r["ids_crc32"]) == (k, zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()))
        total += len(ids)
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(seqs) <= -(-total // 2048) + 1


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in sorted({r: j for j, r in enumerate(rooms)}.values()):
            if rooms[j] >= lengths[k]:
                place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_plans_of_few_pieces_are_nearly_the_best():
    rng = np.random.default_rng(4)
    more = 0
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 11)).tolist()
        plan = packing.plan_sequences(np.bincount(lengths, minlength=21), 20, classes=20)
        assert sorted(x for own, n in plan for x in own * n) == sorted(lengths) and all(sum(own) <= 20 for own, _ in plan)
        extra = sum(n for _, n in plan) - fewest(lengths, 20)
        assert 0 <= extra <= 1
        more += extra
    assert more <= 6


def test_op8(spark, docs):
    got = queries.op8_fingerprints(spark, SF).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute_fingerprints([d[:2] for d in docs]))


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in queries.op10_mixing(spark, SF).collect()}
    sizes, count = defaultdict(int), defaultdict(int)
    for i, t, s in docs:
        n = len((t or "").encode().split())  # of bytes: blank and U+0009 to U+000D alone
        assert got[i]["size"] == n and 0 <= got[i]["taken"] <= 2 * n and got[i]["taken"] in (0, n, 2 * n)
        sizes[s] += n
        count[s] += 1
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)})
    for s in names:
        own = [got[i] for i, _, x in docs if x == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        # a source has ten documents here: the best choice of them comes within half of its smallest one or so
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
    assert sum(r["taken"] for r in got.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)


def test_op4(spark):
    rows = queries.op4_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
