"""Document fingerprints: canonical exact digests, and groups verified byte by byte.

Canonical text: Unicode NFKC, case folded, white space runs as one blank, ends
trimmed. The fingerprint is the 128-bit xxh3 hash of its UTF-8 bytes. Documents of
one fingerprint make a bucket; in buckets of several documents the canonical bytes
are compared, by grouping on the fingerprint and the bytes themselves, which
combines copies on the map side. A bucket that holds different texts gives its
documents, and edited texts with such a fingerprint, longer ones, with the SHA-256 of the
bytes.

The next document is the next by (doc_id, hash of the text). Rows are dealt into ranges of
that pair, so neither an id that repeats nor a null id is one range; a range is
sorted, which may spill, and streamed.

Defined results: a null text is empty; empty texts share one fingerprint; rows alike in
doc_id and text get equal fingerprints and stand next to each other; a null doc_id counts as
smaller than any other; rows of one doc_id are in order of their texts' hashes; very
long texts are read whole; the only document is its own next one; an empty table gives an
empty table; other columns are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import Scratch, materialise


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def text_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """``doc_id, fingerprint`` and, if asked for, ``canon``."""
    names = ["doc_id", "fingerprint", *(["canon"] if with_bytes else [])]

    def run(batches):
        for batch in batches:
            canons = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(c) for c in canons], pa.string()), *([pa.array(canons, pa.binary())] if with_bytes else [])], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string" + ", canon binary" * with_bytes)


_LOW = -1 << 63  # stands for a null doc_id in comparisons


def _key(id_: int | None, h: int) -> tuple[int, int]:
    return (_LOW if id_ is None else id_, h)


def _ranges(marked: DataFrame, target_rows: int, most: int = 65_536) -> list[tuple[int, int]]:
    """Lower bounds that cut the rows into ranges of about ``target_rows``; they only set how even the ranges are.

    The sample that they are read from has about 40 rows for each range.
    """
    n = marked.count()
    ranges = min(most, max(1, -(-n // target_rows)))  # more rows than that make wider ranges, which are streamed
    if ranges == 1:
        return []
    share = int(min(1.0, 40 * ranges / n) * (1 << 30))
    some = sorted(_key(*r) for r in marked.filter(F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(1 << 30)) < share).select("doc_id", "h").collect())
    return sorted({some[k * len(some) // ranges] for k in range(1, ranges)}) if some else []


def _with_range(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``doc_id, h, range`` of ``rows``: how many of the cuts the row reaches."""

    def run(batches):
        for batch in batches:
            found = [bisect_right(cuts, _key(i, h)) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["doc_id", "h", "range"])

    return rows.select("doc_id", "h").mapInArrow(run, "doc_id long, h long, range int")


def _zipped(docs: DataFrame, cuts: list[tuple[int, int]], firsts: list[tuple[int, int | None, int]], doc_id: str, text: str) -> DataFrame:
    """``range, kind, doc_id, h, zip``: texts packed for the shuffle. A range's first row is also the tail (kind 2) of the range before it."""
    before = {(r, i, h): firsts[k - 1][0] for k, (r, i, h) in enumerate(firsts)}  # the first range is the last one's next

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = t.as_py() or b""
                    h = xxhash.xxh64_intdigest(raw) >> 1
                    r, packed = bisect_right(cuts, _key(i, h)), squeeze(raw)
                    out.append((r, 1, i, h, packed))
                    if (r, i, h) in before:
                        out.append((before[(r, i, h)], 2, i, h, packed))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("zip", pa.binary())])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "range int, kind int, doc_id long, h long, zip binary")


def _dealt(docs: DataFrame, marked: DataFrame, shared: DataFrame, cuts: list[tuple[int, int]], doc_id: str, text: str) -> DataFrame:
    """Rows in ranges, each range in order and followed by the first row of the next one.

    ``range, kind, doc_id, h, zip``; kind 0 says that the fingerprint of the row after it comes
    up again, kind 2 marks the next range's row. Of rows alike in doc_id and text the range's
    first ones all are the tail of the range before, which takes one of them.
    """
    firsts = sorted((r["range"], r["f"]["doc_id"], r["f"]["h"]) for r in _with_range(marked, cuts).groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect())  # a row per range
    flags = _with_range(shared, cuts).select("range", F.lit(0).alias("kind"), "doc_id", "h", F.lit(None).cast("binary").alias("zip"))
    dealt = _zipped(docs, cuts, firsts, doc_id, text).unionByName(flags)
    return dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", F.expr("kind = 2"), F.col("doc_id").asc_nulls_first(), "h", "kind")


def document_fingerprints(docs: DataFrame, target_rows: int = 8192, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document, its edited text, the next document by ascending doc_id (the first after the last), and its exact class.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, copies``.
    The edited text's last half of code points is replaced by as many of the next
    document's first. Likeness of exact fingerprints is 1 if the canonical bytes are
    equal, else 0. Texts are shuffled once, packed; where a fingerprint comes up
    again, the bytes behind it are compared.
    """
    scratch = Scratch()
    marked = scratch(_marked(docs, doc_id, text), "fingerprints")
    again = scratch(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "again")
    cuts = _ranges(marked, target_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("sha", pa.string()), ("edited_sha", pa.string()), ("zip", pa.binary())])

    def run(batches):
        packer, opener = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        held, flag = None, None  # the row whose next row isn't known yet; the last row whose bytes are asked for
        for batch in batches:
            out = []
            for range_, kind, id_, h, value in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4), strict=True):
                if kind == 0:
                    flag = (id_, h)
                    continue
                value = opener(value.as_py()).decode("utf-8", "surrogatepass")
                canon = canonical(value)
                if held is not None and held[0] == range_:
                    _, was, old, old_canon, asked = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + value[:half]
                    edited_canon = canonical(edited)
                    out.append((was, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(old_canon), digest(edited_canon), float(old_canon == edited_canon), float(old_canon == canon), hashlib.sha256(old_canon).hexdigest() if asked else None, hashlib.sha256(edited_canon).hexdigest(), packer(old_canon) if asked else None))
                asked = (id_, h) == flag
                held = None if kind == 2 else (range_, id_, value, canon, asked)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = _dealt(docs, marked, marked.join(again, "fingerprint"), cuts, doc_id, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sha string, edited_sha string, zip binary")
    rows = materialise(rows, "rows")
    scratch.drop()
    groups = byte_groups(rows.filter("zip IS NOT NULL").select("doc_id", "fingerprint", F.col("zip").alias("canon"), "sha"))
    return _named(rows, groups)


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The result's columns. Where a bucket has different texts, which is practically never, the bytes' digest tells them and edited texts of that fingerprint apart."""
    out = rows.drop("zip").join(groups, ["fingerprint", "sha"], "left")
    mixed = groups.filter("suffix IS NOT NULL").select(F.col("fingerprint").alias("edited_fingerprint"), F.lit(True).alias("edited_mixed")).distinct()
    out = out.join(mixed, "edited_fingerprint", "left")
    named = F.when(F.col("suffix").isNull(), F.col("fingerprint")).otherwise(F.concat("fingerprint", F.lit("-"), "suffix"))
    edited = F.when(F.col("edited_mixed"), F.concat("edited_fingerprint", F.lit("-"), F.substring("edited_sha", 1, 32))).otherwise(F.col("edited_fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", named.alias("fingerprint"), edited.alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, h, fingerprint`` (16 bytes)."""

    def run(batches):
        for batch in batches:
            raw = [t.as_py() or b"" for t in batch.column(1)]
            h = [xxhash.xxh64_intdigest(x) >> 1 for x in raw]
            found = [xxhash.xxh3_128_digest(canonical(x.decode("utf-8", "surrogatepass"))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "h", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, h long, fingerprint binary")


def byte_groups(rows: DataFrame) -> DataFrame:
    """``fingerprint, sha, class_id, copies, suffix`` of each text in ``rows`` (doc_id, fingerprint, canon, and ``sha`` if canon is packed).

    Rows are grouped by the fingerprint and the bytes themselves, so unequal bytes
    never meet; copies are combined before they are shuffled. suffix is set where
    one fingerprint stands for different bytes.
    """
    rows = rows if "sha" in rows.columns else rows.withColumn("sha", F.sha2("canon", 256))
    groups = rows.groupBy("fingerprint", "canon", "sha").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups.select("fingerprint", "sha", "class_id", "copies"), "groups")
    mixed = groups.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint", F.lit(True).alias("mixed"))
    return groups.join(mixed, "fingerprint", "left").select("fingerprint", "sha", "class_id", "copies", F.when(F.col("mixed"), F.substring("sha", 1, 32)).alias("suffix"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, class_id, copies`` of each row: its exact class, by fingerprint and bytes."""
    rows = text_fingerprints(docs, doc_id, text, with_bytes=True)
    groups = byte_groups(rows)
    named = F.when(F.col("suffix").isNull(), F.col("fingerprint")).otherwise(F.concat("fingerprint", F.lit("-"), "suffix"))
    return rows.select("doc_id", "fingerprint", F.sha2("canon", 256).alias("sha")).join(groups, ["fingerprint", "sha"]).select("doc_id", named.alias("fingerprint"), "class_id", "copies")
