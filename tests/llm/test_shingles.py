"""Near-dedup of the pipeline against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import rows
from vecscore.llm import shingles, simhash


def edited(base, edits, tag):
    w = base.copy()
    for k in range(edits):
        w[(k + 1) * len(w) // (edits + 1)] = f"{tag}x{k}"
    return " ".join(w)


def documents():
    out = []
    for g in range(20):
        base = [f"g{g}w{k}" for k in range(200)]
        out += [(100 * g + e, edited(base, e, f"e{e}"), "en", "s", 1) for e in (0, 2, 3, 4, 6, 12)]
    return out + [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "one two", "en", "s", 1), (9003, "One  TWO", "en", "s", 1), (9004, "one three", "en", "s", 1)]


def all_pairs(docs, least=0.8):
    sets = [set(shingles.shingle_set(shingles.tokens_of((t or "").encode()), 5).tolist()) for _, t, *_ in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    label = simhash.trees(len(docs), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    return sorted({min(docs[j][0] for j in range(len(docs)) if label[j] == k) for k in set(label.tolist())})


def test_groups_at_similarity_of_four_fifths(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    want = all_pairs(docs)
    assert len(want) == 63  # of each base: up to 4 edits, 6 and 12 apart; empty, "one two", "one three"
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want


def test_recall_just_above_four_fifths(spark):
    """Pairs alone in their group, so no third text helps: at least 0.9 of those at 0.8 to 0.83, all far from clear copies."""
    docs = []
    for g in range(400):
        base = [f"p{g}w{k}" for k in range(150 + g % 200)]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, edited(base, (len(base) - 4) // 46, f"e{g}x"))]
    sets = [set(shingles.shingle_set(shingles.tokens_of(t.encode()), 5).tolist()) for _, t in docs]
    near = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(400)]
    assert min(near) >= 0.8 and sum(near) / 400 < 0.84
    root = {r["doc_id"]: r["root"] for r in shingles.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(root[2 * g] == root[2 * g + 1] for g in range(400)) >= 0.9 * 400
    assert len(set(root.values())) >= 400  # and none of another base


def test_recall_on_the_documents(spark):
    """Every pair of different texts of the small table at 0.8 or more, by an index of all shingles."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [set(shingles.shingle_set(shingles.tokens_of((t or "").encode()), 5).tolist()) for _, t in texts]
    holds, pairs = defaultdict(list), []
    for k, own in enumerate(sets):
        common = Counter(j for x in own for j in holds[x])
        pairs += [(j, k) for j, n in common.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)]
        for x in own:
            holds[x].append(k)
    root = {r["doc_id"]: r["root"] for r in shingles.groups(docs).collect()}
    found = [root[texts[i][0]] == root[texts[j][0]] for i, j in pairs]
    assert len(pairs) > 50 and sum(found) >= 0.9 * len(found)
    label = simhash.trees(len(texts), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    alone = [root[i] for k, (i, _) in enumerate(texts) if not any(k in p for p in pairs) and sets[k]]
    assert len(set(alone)) == len(alone) and len(set(label.tolist())) <= len(set(root.values())) + len(pairs)


def test_odd_tables(spark, odd, none):
    kept = shingles.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(all_pairs([(10**9 if r[0] is None else r[0], r[1]) for r in rows()]))
    assert shingles.one_of_each(none).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4])
def test_candidates_are_those_of_all_pairs(spark, m):
    """The second pass, in tries cut into blocks of 5: every pair of different roots within both budgets, once."""
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, (6, shingles.WORDS), dtype=np.uint64)
    w = base[rng.integers(0, 6, 60)]
    for row in w:
        for bit in rng.choice(shingles.BITS, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit) % 64)
    root = rng.integers(0, 40, 60)
    df = spark.createDataFrame([(k, int(root[k]), *[int(x) for x in w[k].view(np.int64)]) for k in range(60)], "node long, root long, " + ", ".join(f"w{k} long" for k in range(shingles.WORDS)))
    got = sorted(map(tuple, shingles.candidates(df, 80, spanned=False, block=5, m=m).collect()))
    want = []
    for a in range(60):
        for b in range(a + 1, 60):
            diff = w[a] ^ w[b]
            heads = [int(diff[t // 2] >> np.uint64(24 * (t % 2))) & 0xFFFFFF for t in range(shingles.TABLES)]
            if root[a] != root[b] and min(h.bit_count() for h in heads) <= 2 and sum(int(x).bit_count() for x in diff) <= shingles.budget(80):
                want.append((a, b))
    assert got == want and want


def test_unlinked_groups_that_share_an_id_both_stay(spark):
    texts = [" ".join(f"{g}{k}" for k in range(40)) for g in "ab"]
    rows = [(1, t, "en", "s", 1) for t in texts] + [(None, " ".join(f"c{k}" for k in range(100)) + end, "en", "s", 1) for end in ("", " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["text"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(kept) == 3 and set(texts) < set(kept)
