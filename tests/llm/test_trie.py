import numpy as np
import pytest

from vecscore.llm import simhash


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size=n // 4, dtype=np.int64).view(np.uint64)
    noisy = np.repeat(base, 3)
    for _ in range(4):
        noisy = noisy ^ (np.uint64(1) << rng.integers(0, 64, size=len(noisy)).astype(np.uint64))
    return np.unique(np.concatenate([base, noisy]))


def brute(v, bits):
    i, j = np.triu_indices(len(v), 1)
    ok = np.bitwise_count(v[i] ^ v[j]) <= bits
    return simhash.trees(len(v), i[ok], j[ok])


@pytest.mark.parametrize("seed", range(4))
def test_trie_self_join_is_that_of_all_pairs(seed):
    v = np.sort(clusters(seed, 400))
    label = simhash.trie_forest(np.zeros(len(v), int), v, 0, 4)
    assert np.array_equal(label, brute(v, 4))


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_parts_miss_no_link(m):
    from itertools import combinations

    v = np.sort(clusters(9, 400))
    cut = simhash.parts(m)
    assert sum(w for _, w in cut) == 64
    i_all, j_all = [], []
    for chosen in combinations(range(m), m - 4):
        x = simhash.arranged(v, chosen, cut)
        depth = sum(cut[k][1] for k in chosen)
        group = np.unique(x >> np.uint64(64 - depth), return_inverse=True)[1]
        order = np.lexsort((x, group))
        label = simhash.trie_forest(group[order], x[order], depth, 4)
        up = np.flatnonzero(label != np.arange(len(label)))
        i_all.append(order[up])
        j_all.append(order[label[up]])
    assert np.array_equal(simhash.trees(len(v), np.concatenate(i_all), np.concatenate(j_all)), brute(v, 4))


def test_fingerprint_by_its_definition():
    import xxhash

    text = "Aa bb\tCC dd ee aa bb cc dd é"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", seed=42)
