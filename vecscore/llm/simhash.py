"""SimHash near-dedup: binary trie self-join over 64-bit fingerprints.

A fingerprint has a bit set where more than half of a text's shingle hashes have
it. Two fingerprints link at ``bits`` differing bits or fewer. The self-join walks
pairs of trie nodes together, adds up differing bits and drops a pair beyond the
budget. To spread it over tasks, the 64 bits are cut into ``m`` parts: linked
fingerprints agree wholly on at least ``m - bits`` parts, so for every choice of
that many parts the tries below equal values of them are joined on their own, and
no link is missed. ``m`` follows the number of fingerprints, so the tries stay
small. A trie above ``block`` fingerprints is dealt out as pairs of blocks.

A task emits a spanning forest of its links, not the links: never more rows than
it read. Node pairs whose members are all in one tree already are dropped.

Defined results: null and empty texts have fingerprint zero and link like others;
copies share a fingerprint, which is joined once; a null doc_id takes the smallest
id of its component, null if none has one; repeated rows get equal results; a bit that
exactly half of the hashes have is 0; very long texts are hashed whole, in portions; an
empty table gives an empty table; other columns of ``docs`` are not read, so no name clashes.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.llm.common import Scratch, materialise
from vecscore.llm.graph import components

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Unsigned fingerprint of the UTF-8 bytes of a text."""
    tokens = text.lower().split() if text else []  # of bytes: A to Z, and white space as in the contract
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        some = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + _CHUNK)], ends[min(words, len(tokens)) - 1 + at :], strict=False)]
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def trees(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _halves(v, lo, hi, depth):
    """First place in lo..hi whose bit at depth (0 is the highest) is set; the range is sorted and agrees above."""
    shift = (63 - depth).astype(np.uint64)
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) // 2
        bit = (v[np.minimum(mid, len(v) - 1)] >> shift) & np.uint64(1)
        right = open_ & (bit == 0)
        b = np.where(open_ & ~right, mid, b)
        a = np.where(right, mid + 1, a)
    return a


class Trees:
    """Which tree each row is in, named by the place of one of its rows; rows of one tree need no further link."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self._turns()

    def _turns(self):
        """A range of rows is of one tree if its ends have the same number of turns."""
        self.turn = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, int)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.label)
        self.label = trees(n, np.concatenate([np.arange(n), i]), np.concatenate([self.label, j]))
        self._turns()

    def same(self, a0, a1, b0, b1) -> np.ndarray:
        return (self.turn[a0] == self.turn[a1 - 1]) & (self.turn[b0] == self.turn[b1 - 1]) & (self.label[a0] == self.label[b0])


def trie_pairs(group: np.ndarray, v: np.ndarray, depth: int, bits: int, known: Trees, width: int = 64, portion: int = 50_000):
    """Pairs (i, j), i < j, of one group that are in different trees and differ in ``bits`` bits or fewer, in bounded portions.

    Rows are sorted by group and value; values of a group agree in their first
    ``depth`` bits and have ``width`` bits. Pairs of trie nodes are walked together,
    the bits in which they differ are added up, and a pair beyond the budget is left.
    ``known`` may grow between portions: node pairs within one tree are left too.
    """
    n = len(v)
    lo = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
    hi = np.append(lo[1:], n) if n else lo
    stack = [np.stack([lo, hi, lo, hi, np.zeros_like(lo), np.full_like(lo, depth)])]
    while stack:
        x = stack.pop()
        if x.shape[1] > portion:
            stack.append(x[:, portion:])
            x = x[:, :portion]
        x = x[:, ~known.same(*x[:4])]
        leaf = (x[1] - x[0]) * (x[3] - x[2]) <= 64
        y = x[:, leaf]
        if y.shape[1]:
            nb = y[3] - y[2]
            each = (y[1] - y[0]) * nb
            of = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            i, j = y[0][of] + k // nb[of], y[2][of] + k % nb[of]
            ok = (i < j) & (known.label[i] != known.label[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(v[i] ^ v[j]) <= bits
            if ok.any():
                yield i[ok], j[ok]
        x = x[:, ~leaf]
        if x.shape[1]:
            a0, a1, b0, b1, d, at = x
            below = at < width
            # rows that agree in every bit are halved by their places
            am = np.where(below, _halves(v, a0, a1, np.minimum(at, 63)), (a0 + a1) // 2)
            bm = np.where(below, _halves(v, b0, b1, np.minimum(at, 63)), (b0 + b1) // 2)
            other = a0 != b0
            more, next_ = d + below, at + below
            kids = [np.stack([a0, am, b0, bm, d, next_]), np.stack([am, a1, bm, b1, d, next_]), np.stack([a0, am, bm, b1, more, next_]), np.stack([am, a1, b0, bm, more, next_])[:, other]]
            kids = np.concatenate(kids, axis=1)
            stack.append(kids[:, (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= bits)])


def trie_forest(group: np.ndarray, v: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Component label of each row; rows of a group, sorted and distinct, link at ``bits`` differing bits or fewer."""
    n = len(v)
    near_i, near_j = [np.zeros(0, int)], [np.zeros(0, int)]
    for step in (1, 2, 3, 5, 8):  # neighbours first: they make the trees that let whole nodes be skipped
        if n > step:
            ok = (group[step:] == group[:-step]) & (np.bitwise_count(v[step:] ^ v[:-step]) <= bits)
            near_i.append(np.flatnonzero(ok))
            near_j.append(near_i[-1] + step)
    known = Trees(np.arange(n))
    known.link(np.concatenate(near_i), np.concatenate(near_j))
    found, held = [], 0
    for i, j in trie_pairs(group, v, depth, bits, known):
        found.append((i, j))
        held += len(i)
        if held > 2_000_000:
            known.link(*map(np.concatenate, zip(*found, strict=True)))
            found, held = [], 0
    if found:
        known.link(*map(np.concatenate, zip(*found, strict=True)))
    return known.label


def parts(m: int, width: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of m parts of ``width`` bits."""
    edges = [width * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choose_parts(n: int, bits: int, mean: int = 64, width: int = 64) -> int:
    """The least m whose keys leave about ``mean`` fingerprints to a trie; at most bits + 4."""
    m = bits + 1
    while m < bits + 4 and n >> (width * (m - bits) // m) > mean:
        m += 1
    return m


def trie_tasks(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """Tasks for so many rows of tries: enough that one holds about ``each``, and no fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each), 1)


def whole_groups(batches, n_keys: int, limit: int = 200_000):
    """Arrays of columns from Arrow batches sorted by their first ``n_keys`` columns; no key's rows are in two of them."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(x).to_numpy().astype(np.int64) for x in range(batch.num_columns)]))
        size += batch.num_rows
        if size < limit:
            continue
        x = np.concatenate(held, axis=1)
        last = (x[:n_keys] != x[:n_keys, -1:]).any(axis=0)  # the last group may go on
        end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if end:
            yield x[:, :end]
        held, size = [x[:, end:]], x.shape[1] - end
    if size:
        yield np.concatenate(held, axis=1)


def arranged(v: np.ndarray, chosen: tuple[int, ...], cut: list[tuple[int, int]]) -> np.ndarray:
    """The values with the bits of the chosen parts first."""
    out = np.zeros_like(v)
    for k in [*chosen, *(k for k in range(len(cut)) if k not in chosen)]:
        low, width = cut[k]
        out = (out << np.uint64(width)) | ((v >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def dealt_tries(rows: DataFrame, node: str, block: int, tasks: int) -> DataFrame:
    """``rows`` (c, key, and others) with ``pair``, in tasks of whole (c, key, pair); a trie above ``block`` rows is dealt out as pairs of blocks.

    Rows of a block are in every pair of it, so each two rows of a trie meet in one pair at least.
    """
    large = rows.groupBy("c", "key").count().filter(F.col("count") > block).select("c", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = materialise(large, "large_tries")
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o).cast("long") * F.col("blocks") + F.greatest(own, o)))
    dealt = rows.join(large, ["c", "key"], "left").withColumn("pair", F.explode(pair)).drop("blocks")
    return dealt.repartition(tasks, "c", "key", "pair").sortWithinPartitions("c", "key", "pair")


def links(nodes: DataFrame, bits: int = 4, block: int = 8192, m: int | None = None) -> DataFrame:
    """``a, b``: edges between fingerprints whose components are those of all links. ``nodes``: distinct ``fp``."""
    n = nodes.count()
    m = m or choose_parts(n, bits)
    cut = parts(m)
    choices = list(combinations(range(m), m - bits))
    masks = [sum(((1 << cut[k][1]) - 1) << cut[k][0] for k in chosen) for chosen in choices]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    rows = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed])).alias("c", "key"))
    dealt = dealt_tries(rows, "fp", block, trie_tasks(nodes.sparkSession, n * len(choices)))
    depths = [sum(cut[k][1] for k in chosen) for chosen in choices]

    def forest(c, key, pair, fp):
        """Edges of whole groups that are held in memory."""
        for k in np.unique(c):
            own = c == k
            v = arranged(fp[own].view(np.uint64), choices[k], cut)
            group = np.unique(np.stack([key[own], pair[own]]), axis=1, return_inverse=True)[1].ravel()
            order = np.lexsort((v, group))
            label = trie_forest(group[order], v[order], depths[k], bits)
            here = fp[own][order]
            up = np.flatnonzero(label != np.arange(len(label)))
            if len(up):
                yield pa.RecordBatch.from_arrays([pa.array(here[up]), pa.array(here[label[up]])], names=["a", "b"])

    def run(batches):
        for x in whole_groups(batches, 3):
            yield from forest(*x)

    return dealt.select("c", "key", "pair", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id, copies, root`` for each row of ``docs``; root is the component's own name, whatever its ids."""
    marked = materialise(fingerprints(docs, words, doc_id, text), "fingerprints")
    scratch = Scratch()
    nodes = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = scratch(components(links(nodes.select("fp"), bits)), "components")
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    first = roots.join(nodes.select(F.col("fp").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(first, "root").select(F.col("node").alias("fp"), "root", "least")
    # written, so that both sides of the last join are plain exchanges and a fingerprint of many rows can be split
    classes = materialise(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "copies", F.coalesce("root", "fp").alias("root")), "classes")
    scratch.drop()
    return marked.join(classes, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies", "root")


def one_of_each(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each ``root`` in ``groups`` (doc_id, text_hash, root) the one with the smallest doc_id.

    A null id stays only where its group has no other; of rows that repeat that id the
    one with the smallest text hash stays, and one of rows alike in id and text.
    """
    own = materialise(groups.select("doc_id", "text_hash", "root"), "groups")
    rows = own.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rows")).alias("s")
    stays = materialise(rows.groupBy("root").agg(first).select("s.doc_id", "s.text_hash", "s.rows"), "stays")
    # only rows that repeat in id and text are compared with each other
    single, several = stays.filter("rows = 1"), stays.filter("rows > 1")
    at = lambda some: docs[doc_id].cast("long").eqNullSafe(some["doc_id"]) & (F.xxhash64(docs[text]) == some["text_hash"])
    return docs.join(single, at(single), "left_semi").unionByName(docs.join(several, at(several), "left_semi").dropDuplicates([doc_id, text]))
