"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token ids, each followed by an end id; longer ones than a
sequence are cut into whole sequences with the shorter piece first. What is left
to pack is a histogram over lengths, of at most ``capacity`` entries whatever the
corpus. Lengths are rounded up to classes; all patterns of up to ``parts``
documents whose classes fill a sequence are listed, and non-negative least
squares fits their repeat counts to the histogram. Counts are rounded down, the
patterns are filled with true lengths, and what remains goes best fit, longest
first, into the room left over and new sequences. All of this handles counts of
like sequences, so its work follows the number of lengths, not of documents.

The plan gives each (length, rank) a sequence and an offset. Pieces get their rank
from counts per (bucket, length), summed over buckets, so no length is ever
gathered in one task.

Defined results: null and empty texts are their end id alone; repeated rows are
packed one by one, and :func:`numbered_copies` tells their pieces apart; pieces of equal
length are dealt out by (doc_id, piece, checksum); a null doc_id is an id; very long texts are
encoded whole and cut; sequence ids are distinct numbers without further meaning; an empty
table gives an empty table; other columns of ``docs`` are not read, so no name clashes.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecscore.llm.common import materialise

#: Letters beyond Latin and the general marks go through the tokenizer file itself.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e¡-ſ‐-‧]*")


def load_encoder(vocabulary: str, ranks: str | None = None):
    """A function from text to ids, as the tokenizer file has them.

    ``ranks`` is the same vocabulary as byte-pair ranks, which another library
    reads faster; it is used for texts of Latin letters without special tokens,
    where both give the same ids.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)

    def exact(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return exact
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's public split pattern
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    marks = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(m in text for m in marks):
            return fast.encode_ordinary(text)
        return exact(text)

    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches):
        encode = load_encoder(vocabulary, ranks)
        for batch in batches:
            rows, held = [], 0
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((id_, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if keep_ids else [])))
                    held += b - a
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``parts`` classes that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for k in range(min(left, head[-1] if head else left), 0, -1):
                if k * (parts - len(head)) < left:
                    break
                grow((*head, k), left - k)

    grow((), classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 384) -> np.ndarray:
    """x >= 0 with the least |a x - b|: an active set grown by the steepest column, as of Lawson and Hanson."""
    n = a.shape[1]
    x, used, barred = np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    gram, right = a.T @ a, a.T @ b
    for _ in range(rounds):
        slope = right - gram @ x
        slope[used | barred] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-6 * scale:
            break
        used[k] = True
        while used.any():
            own = np.flatnonzero(used)
            best = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if best[own == k].min(initial=1.0) <= 1e-9 * scale:  # it can't enter now; others may
                used[k], barred[k] = False, True
                break
            low = best <= 1e-12 * scale
            if not low.any():
                x[:] = 0
                x[own] = best
                barred[:] = False
                break
            gap = x[own][low] - best[low]
            step = float(np.min(np.divide(x[own][low], gap, out=np.zeros(gap.shape), where=gap > 0)))
            x[own] += step * (best - x[own])
            drop = own[x[own] <= 1e-12 * scale]
            drop = drop[drop != k] if len(drop) and step < 1 else drop
            x[drop] = 0
            used[drop] = False
            if not len(drop):
                used[own[low]] = False
    return x


def plan_sequences(histogram: np.ndarray, capacity: int, classes: int = 128, parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); ``histogram[l]`` counts pieces of length l, 1 to capacity."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    width = -(-capacity // classes)
    room_of = capacity // width
    # classes of which each pattern is made: class k holds lengths up to k * width
    of = -(-np.arange(capacity + 1) // width)
    have = np.bincount(of, weights=left, minlength=room_of + 2)[: room_of + 1]
    found = [p for p in patterns(room_of, parts) if len(p) > 1 and all(have[k] for k in p)]
    half: list[tuple[tuple[int, ...], int]] = []
    if found:
        a = np.zeros((room_of + 1, len(found)))
        for j, p in enumerate(found):
            for k in p:
                a[k, j] += 1
        counts = np.floor(nnls(a, have) + 1e-6).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        spare = have.astype(np.int64)
        for j in order:
            p = found[j]
            need = {k: p.count(k) for k in p}
            times = int(min(counts[j], *(spare[k] // c for k, c in need.items())))
            if times <= 0:
                continue
            for k, c in need.items():
                spare[k] -= c * times
            # each slot takes the class's lengths in order; runs of like lengths split the count
            runs = [(times, ())]
            for k in p:
                taken, out = [], times
                for length in range(min(k * width, capacity), (k - 1) * width, -1):
                    if out and left[length]:
                        n = int(min(out, left[length]))
                        taken.append([n, length])
                        left[length] -= n
                        out -= n
                joined, at = [], 0
                for n, lengths in runs:
                    while n:
                        m = min(n, taken[at][0])
                        joined.append((m, (*lengths, taken[at][1])))
                        n -= m
                        taken[at][0] -= m
                        at += taken[at][0] == 0
                runs = joined
            half += [(lengths, n) for n, lengths in runs]
    # best fit, longest first, over counts of sequences with like room
    rooms: dict[int, list[list]] = {}
    keys: list[int] = []

    def add(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in rooms:
            rooms[room] = []
            bisect.insort(keys, room)
        rooms[room].append([lengths, n])

    for lengths, n in half:
        add(lengths, n)
    for length in range(capacity, 0, -1):
        c = int(left[length])
        while c:
            i = bisect.bisect_left(keys, length)
            if i == len(keys):
                per = capacity // length
                if c >= per:
                    add((length,) * per, c // per)
                    c %= per
                else:
                    add((length,) * c, 1)
                    c = 0
                continue
            room = keys[i]
            lengths, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            m = min(n, c)
            if n > m:
                add(lengths, n - m)
            add((*lengths, length), m)
            c -= m
    merged: dict[tuple[int, ...], int] = {}
    for lengths, n in plan + [(tuple(x[0]), x[1]) for entry in rooms.values() for x in entry]:
        merged[lengths] = merged.get(lengths, 0) + n
    return sorted(merged.items(), reverse=True)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: from which rank on pieces of a length lie in which sequences and at which offset."""
    rows, used, first = [], {}, 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    x = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": x[:, 0], "rank": x[:, 1], "sequence": x[:, 2], "offset": x[:, 3]}


def pack(cut: DataFrame, capacity: int = 2048, classes: int = 128, parts: int = 3) -> DataFrame:
    """``cut`` (with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    n = cut.count()
    buckets = max(1, -(-n // 2048))
    # within a bucket and length, rows are told apart by all that they are
    bucketed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = materialise(bucketed.groupBy("_b", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    table = slots(plan_sequences(histogram, capacity, classes, parts))
    # ranks: those of a length in the buckets before, then the row's own
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_b")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = bucketed.withColumn("_own", own).join(before, ["_b", "length"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    names = [c for c in cut.columns]
    fields = [*cut.schema.fields]
    base = np.searchsorted(table["length"], np.arange(capacity + 2))

    def run(batches):
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            # the last slot of the length that begins at or before the rank
            lo, hi = base[length].copy(), base[length + 1].copy()
            while (lo + 1 < hi).any():
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (table["rank"][np.minimum(mid, len(table["rank"]) - 1)] <= rank)
                hi = np.where((lo + 1 < hi) & ~right, mid, hi)
                lo = np.where(right, mid, lo)
            sequence = table["sequence"][lo] + rank - table["rank"][lo]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(table["offset"][lo])], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    return ranked.select(*names, "_rank").mapInArrow(run, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def numbered_copies(packed: DataFrame) -> DataFrame:
    """``packed`` with ``copy``: 0, 1, ... among like pieces of rows that repeat a doc_id and text.

    Each number has every piece of the document once, so one copy can be read back by (doc_id, copy).
    """
    like = Window.partitionBy("doc_id", "piece", "start", "length", "ids_crc32").orderBy("sequence_id", "offset")
    return packed.withColumn("copy", F.row_number().over(like) - 1)


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack; tokens are counted once, from a written table."""
    cut = materialise(pieces(docs, vocabulary, ranks, capacity, end_id, keep_ids, doc_id, text), "pieces")
    return pack(cut, capacity)
