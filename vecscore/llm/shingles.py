"""Near duplicates by the similarity of their word shingles: SimHash tries find the pairs, the shingle sets decide.

Two texts link if the Jaccard similarity of their sets of ``words``-word shingles is
``percent`` or more (64-bit hashes stand for the shingles; texts are lowered and
split as for the 64-bit fingerprints of ``simhash``). Where a contract asks for a
number of differing bits, ``simhash.near_duplicates`` is the operator; this one is for
a similarity, which 64 bits can't tell: at 0.8 two of them differ in about 10.

A text has a SimHash of ``BITS`` bits over its distinct shingles. Two sets of Jaccard
similarity J differ in a share p = acos(2 J / (1 + J)) / pi of them, 0.152 at 0.8.
The fingerprint has ``TABLES`` heads of ``HEAD`` bits. For each head the tries of
``simhash`` are joined with themselves with a budget of ``HEAD_BITS`` differing bits,
and of the pairs found there, those within the whole fingerprint's budget (the mean at
``percent`` and ``SPREAD`` standard deviations) are compared by their shingles. By
calculation a pair at exactly 0.8 is found with a chance of 0.91, one at 0.85 with
0.99; groups lose less, as a text has several links.

A row is sent to ``TABLES`` times C(m, 2) tries of n / 2**(24 (m - 2) / m) rows each: 30 for up
to a million texts, 60 up to 17 million, 100 up to 70 million, 150 beyond. That is what
a similarity of 0.8 costs with SimHash; tries above a block are dealt out in pairs of blocks.

The join runs twice. First the tasks send spanning forests of what they find, not all
pairs, and these links are compared. Then only texts that have a candidate are joined
again, and all pairs between groups that are still apart are compared. No pair within a
group that the first pass linked is ever made, and no candidate is capped or sampled.

Defined results: null and empty texts are copies of each other and of nothing else;
texts with equal words are copies and are joined once; a text shorter than a shingle is one
shingle; a similarity of exactly ``percent`` links; ties go to the smallest doc_id; very long
texts are hashed whole; repeated rows are in one group; an empty table gives an empty
table; other columns of ``docs`` are not read, so no name clashes. A text is known by a
64-bit hash of its words.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm import simhash
from vecscore.llm.common import Scratch, materialise
from vecscore.llm.graph import components
from vecscore.llm.simhash import SEED, Trees, trie_pairs

TABLES, HEAD, HEAD_BITS = 10, 24, 2
WORDS = TABLES // 2  # of 64 bits, two heads in each
BITS = 64 * WORDS
SPREAD = 1.65
#: Rows of a trie that are worth more parts of the heads: with them a row goes to more, smaller tries.
MEAN = 4096
_CHUNK = 255  # votes of so many shingles fit a byte
_W = [f"w{k}" for k in range(WORDS)]


def tokens_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def node_of(tokens: list[bytes]) -> int:
    """Signed hash that texts with equal words share."""
    h = xxhash.xxh3_64_intdigest(b" ".join(tokens))
    return h - (1 << 64) if h >> 63 else h


def shingle_set(tokens: list[bytes], words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles; none without a word."""
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(tokens[k : k + words]), SEED) for k in range(n)), dtype=np.uint64, count=n))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` words: a bit is set if over half of the shingles have it, each shingle mixed anew for each word."""
    n, votes = len(shingles), np.zeros(BITS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, n, _CHUNK):
            z = shingles[at : at + _CHUNK, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            bits = np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64)


def budget(percent: int, spread: float = SPREAD) -> int:
    """Differing bits of the whole fingerprint that a pair at ``percent`` stays within."""
    j = percent / 100
    p = math.acos(2 * j / (1 + j)) / math.pi
    return math.floor(BITS * p + spread * math.sqrt(BITS * p * (1 - p)))


def fingerprints(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, node, n, w0, w1, ...`` of each row; ``n`` is its number of distinct shingles."""

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            node, n, w = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros((size, WORDS), np.uint64)
            for k, t in enumerate(batch.column(2)):
                own = tokens_of(t.as_py())
                found = shingle_set(own, words)
                node[k], n[k], w[k] = node_of(own), len(found), wide_fingerprint(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(n), *[pa.array(x.view(np.int64)) for x in w.T.copy()]], names=["doc_id", "text_hash", "node", "n", *_W])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, n int, " + ", ".join(f"{x} long" for x in _W))


def found_before(diff: np.ndarray, t: int, chosen: int, masks: list[int]) -> np.ndarray:
    """Whether a pair, given as the words' differing bits, is in the trie of an earlier head or choice too: only its first trie sends it."""
    head = lambda k: (diff[k // 2] >> np.uint64(HEAD * (k % 2))) & np.uint64((1 << HEAD) - 1)
    before = np.zeros(diff.shape[1], bool)
    for k in range(t):
        before |= np.bitwise_count(head(k)) <= HEAD_BITS
    for mask in masks[:chosen]:
        before |= head(t) & np.uint64(mask) == 0
    return before


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a lightest spanning forest of nodes 0 to n - 1: each tree's lightest edge outwards, round by round."""
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(a))
    label, at, chosen = np.arange(n), np.arange(len(a)), []
    while len(at):
        x, y = label[a[at]], label[b[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            break
        best = np.full(n, len(a), np.int64)
        np.minimum.at(best, x, rank[at])
        np.minimum.at(best, y, rank[at])
        picked = at[(rank[at] == best[x]) | (rank[at] == best[y])]
        chosen.append(picked)
        label = simhash.trees(n, np.concatenate([np.arange(n), a[picked]]), np.concatenate([label, b[picked]]))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _choices(m: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]], list[int]]:
    """The parts of a head, the choices of as many as linked heads have in common, and the choices' masks."""
    cut = simhash.parts(m, HEAD)
    choices = list(combinations(range(m), m - HEAD_BITS))
    return cut, choices, [sum(((1 << cut[k][1]) - 1) << cut[k][0] for k in chosen) for chosen in choices]


def _dealt(nodes: DataFrame, m: int, block: int) -> DataFrame:
    """``c, key, pair, node, root, w0, ...``: for each head and choice of its parts, the rows below one key together."""
    masks = _choices(m)[2]
    keys = [F.shiftrightunsigned(F.col(_W[t // 2]), HEAD * (t % 2)).bitwiseAND(F.lit(mask)) for t in range(TABLES) for mask in masks]
    rows = nodes.select("node", "root", *_W, F.posexplode(F.array(*keys)).alias("c", "key"))
    return simhash.dealt_tries(rows, "node", block, simhash.trie_tasks(nodes.sparkSession, nodes.count() * len(keys))).select("c", "key", "pair", "node", "root", *_W)


def candidates(nodes: DataFrame, percent: int, spanned: bool, block: int = 8192, m: int | None = None) -> DataFrame:
    """``a, b``: pairs of nodes of different roots that are within the budgets; ``nodes``: ``node, root, w0, ...``.

    With ``spanned`` a task sends, of each portion, a lightest spanning forest of what it
    found, and another of the links that are well within the budget: the latter make the
    trees within which it looks no further. A link that an earlier head's trie has too is
    left to that trie, where it, or a path in its place, is sent.
    """
    m = m or simhash.choose_parts(nodes.count(), HEAD_BITS, MEAN, HEAD)
    cut, choices, masks = _choices(m)
    most, sure = budget(percent), budget(min(99, percent + 3), 0.0)

    def run(batches):
        for x in simhash.whole_groups(batches, 3):
            c, key, pair, node, root = x[:5]
            words = x[5:].view(np.uint64)
            for k in np.unique(c):
                here = np.flatnonzero(c == k)
                t, which = divmod(int(k), len(choices))
                chosen = choices[which]
                head = (words[t // 2, here] >> np.uint64(HEAD * (t % 2))) & np.uint64((1 << HEAD) - 1)
                v = simhash.arranged(head, chosen, cut) << np.uint64(64 - HEAD)
                group = np.unique(np.stack([key[here], pair[here]]), axis=1, return_inverse=True)[1].ravel()
                order = np.lexsort((root[here], v, group))
                here, v, group = here[order], v[order], group[order]
                w, n = words[:, here], len(here)
                first, of = np.unique(root[here], return_index=True, return_inverse=True)[1:]
                known = Trees(first[of])
                loose = Trees(known.label.copy())
                for i, j in trie_pairs(group, v, sum(cut[p][1] for p in chosen), HEAD_BITS, known, HEAD, 8192):
                    diff = w[:, i] ^ w[:, j]
                    apart = np.bitwise_count(diff).sum(axis=0, dtype=np.int64)
                    ok = apart <= most
                    i, j, apart, diff = i[ok], j[ok], apart[ok], diff[:, ok]
                    if spanned and len(i):
                        near = np.flatnonzero(apart <= sure)
                        near = near[spanning(known.label[i[near]], known.label[j[near]], apart[near], n)]
                        rest = spanning(loose.label[i], loose.label[j], apart, n)
                        loose.link(i[rest], j[rest])
                        if len(near):
                            known.link(i[near], j[near])
                        taken = np.union1d(near, rest)
                        i, j, diff = i[taken], j[taken], diff[:, taken]
                    new = ~found_before(diff, t, which, masks)
                    i, j = i[new], j[new]
                    if len(i):
                        a, b = node[here[i]], node[here[j]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _dealt(nodes, m, block).mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, words: int, text: str) -> DataFrame:
    """``node, shingles`` of the given ``node, text_hash``."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = [tokens_of(t.as_py()) for t in batch.column(0).slice(k, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in own], pa.int64()), pa.array([shingle_set(x, words).view(np.int64) for x in own], pa.list_(pa.int64()))], schema=schema)

    wanted = docs.join(nodes.select("text_hash"), F.xxhash64(docs[text]) == F.col("text_hash"), "left_semi")
    # rows that repeat a text meet here, before it is split; of a node just one text is asked for
    own = wanted.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("binary").alias("t")).groupBy("h").agg(F.first("t").alias("t"))
    return own.select("t").mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, words: int, percent: int, text: str = "text") -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets are similar enough; ``texts`` has ``node, text_hash, n``."""
    scratch = Scratch()
    sized = pairs.join(texts.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(texts.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    # sets of too different sizes can't be similar enough
    pairs = scratch(sized.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = scratch(_sets(docs, scratch(texts.join(wanted, "node"), "wanted"), words, text), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = materialise(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    scratch.drop()
    return links


def groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, root`` of each row: rows of one group of near duplicates share ``root``."""
    marked = materialise(fingerprints(docs, words, doc_id, text), "fingerprints")
    scratch = Scratch()
    first = [F.first(c).alias(c) for c in ("n", *_W)]
    nodes = scratch(marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *first).filter("n > 0"), "nodes")
    texts = nodes.select("node", "text_hash", "n")
    tried = scratch(candidates(nodes.withColumn("root", F.col("node")), percent, spanned=True), "candidates")
    links = verified(tried, docs, texts, words, percent, text)
    scratch.tables.append(links)
    found = scratch(components(links), "components")
    # once more, between the groups of those that have a candidate at all
    open_ = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    open_ = scratch(nodes.join(open_, "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "open")
    rest = scratch(candidates(open_, percent, spanned=False).join(tried, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, docs, texts, words, percent, text)
    scratch.tables.append(more)
    found = materialise(components(links.unionByName(more)), "components")
    scratch.drop()
    return marked.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group: see ``simhash.one_of_each``."""
    return simhash.one_of_each(docs, groups(docs, words, percent, doc_id, text), doc_id, text)
