"""Line dedup: deletion-neighbourhood join of the corpus's lines; the earliest stays.

Lines are compared by their words (white space folded, A to Z in lower case). Two
lines match if they are equal, or if both have at least ``min_words`` words and one
word inserted, deleted or replaced turns one into the other. The default of 5 words is
where such an edit leaves four fifths of a line. A line goes if any earlier line (by
doc_id, then place) matches it; the rule is about the lines as they were read, so it
doesn't depend on the order of work.

The join: each distinct line emits its hash and those of its one-word deletions. A
line and a deletion that are equal are an insertion apart; two deletions that are
equal, made at one place, are a replacement apart. Each line meets only the
earliest line of every key, so a key's lines are never paired with each other, and
the words of each such pair are then compared.

Most lines match nothing. One edit leaves the first or the last ``a`` words as they
are, a being about half of them; only lines that share such a half with a different
line emit deletions, and only at the places outside the shared half. Of the
deletions, only those whose hash comes up in different lines are joined. Both filters
are joins with written tables of keys, whatever their number: the planner sends such a
table to all tasks if it is small, and else splits a key of many rows.

Defined results: blank lines never match and stay where their text stays as it is;
a text that loses every line becomes empty; null texts stay null; a null doc_id comes
before all others; rows alike in doc_id and text are one document and lose like lines; of
equal ids the smaller text hash is earlier; lines of any length are compared whole; an
empty table gives an empty table; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import SPACES, Scratch, ascii_lower, boxed, materialise, unboxed

#: An edit of one word in so many leaves four fifths of a line.
MIN_WORDS = 5
_BASE = 0x9E3779B97F4A7C15  # odd: the polynomial's base, modulo 2**64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def half_keys(words: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first, end) of the line's halves, and the places that an edit may have if the half is shared.

    Lines one edit apart have the same ``a`` for at least one of their levels. Below
    8 words ``a`` is 0: such lines all share the empty half and emit every deletion, as
    do those of 8 words if lines of 7 may match them.
    """
    n = len(words)
    out = []
    for a in (4 * (n // 8), *([4 * (n // 8 - 1)] if n % 8 == 0 and (n >= 16 or min_words < 8) else [])):
        out.append((_signed(xxhash.xxh64_intdigest(b"%d<" % a + b" ".join(words[:a]))), a, n))
        out.append((_signed(xxhash.xxh64_intdigest(b"%d>" % a + b" ".join(words[n - a :]))), 0, n - a))
    return out


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line itself and of the line without word 0, 1, ... (``len(words) + 1`` of them)."""
    n = len(words)
    with np.errstate(over="ignore"):
        w = np.array([xxhash.xxh64_intdigest(x) | 1 for x in words], dtype=np.uint64)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        # head[k] and tail[k]: polynomials of the first k words, and of those from word k on
        terms = w * power[n - 1 :: -1][:n]
        head_all = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)])  # scaled as in the whole line
        tail = head_all[-1] - head_all
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        deleted = head_all[:-1] * inverse + tail[1:]
        return np.concatenate([head_all[-1:] + np.uint64(n), deleted + np.uint64(n - 1)]).view(np.int64)


def _batches(rows, schema: pa.Schema, size: int = 8192):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _lines_of(batch):
    """(id, dg, place, line, words) of each line with a word."""
    for id_, dg, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        for pos, line in enumerate((value.as_py() or b"").split(b"\n")):
            if words := line.lower().split():
                yield id_, dg, pos, line, words


def line_hash(words: list[bytes]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(b" ".join(words))
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _flat(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("dg"), F.col(text).cast("binary").alias("text"))


def line_classes(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct line: ``h1, h2``, ``first`` (id, dg, pos of its first place), its number of words ``n`` and the hashes of its halves.

    ``k0`` to ``k3`` are hashes of the first and last words as in :func:`half_keys`, null where there are fewer
    and in lines below ``min_words``.
    """
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 4
    names = ["h1", "h2", "id", "dg", "pos", "n", "k0", "k1", "k2", "k3"]

    def row(id_, dg, pos, words):
        keys = [k for k, *_ in half_keys(words, min_words)] if len(words) >= min_words else []
        return (*line_hash(words), id_, dg, pos, len(words), *keys, *[None] * (4 - len(keys)))

    def run(batches):
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            yield from _batches((row(i, dg, pos, words) for i, dg, pos, _, words in _lines_of(batch)), schema)

    rows = _flat(docs, doc_id, text).mapInArrow(run, "h1 long, h2 long, id long, dg long, pos int, n int, k0 long, k1 long, k2 long, k3 long")
    rest = [F.first(c).alias(c) for c in names[5:]]
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "dg", "pos")).alias("first"), *rest)


def _shared(rows: DataFrame, scratch) -> DataFrame:
    """The keys of ``rows`` (k, h1) that different lines have, as a written table."""
    return scratch(rows.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("k"), "shared_keys")


def _halves(classes: DataFrame, min_words: int) -> DataFrame:
    """``k, h1, h2, low, high`` of each half: an edit of lines that share it is at one of the places [low, high)."""
    a = (F.lit(4) * F.floor(F.col("n") / 8)).cast("int")

    def half(k: str, low, high):
        return F.struct(F.col(k).alias("k"), low.cast("int").alias("low"), high.cast("int").alias("high"))

    n, zero = F.col("n"), F.lit(0)
    each = F.array(half("k0", a, n), half("k1", zero, n - a), half("k2", a - 4, n), half("k3", zero, n - a + 4))
    # without words in a half, all lines share it: see _open_lines
    return classes.filter(F.col("n") >= min_words).select("h1", "h2", F.explode(each).alias("x")).select("x.k", "h1", "h2", "x.low", "x.high").filter("k IS NOT NULL AND high - low > 0")


def _is_short(min_words: int):
    """Lines with an empty half: all of their places may be edited."""
    return (F.col("n") < 8) | ((F.col("n") == 8) & F.lit(min_words < 8))


def open_lines(classes: DataFrame, min_words: int, scratch=materialise) -> DataFrame:
    """``h1, h2, first, low, high`` of the distinct lines that may match another: those that share a half, and those too short for halves."""
    long_ = classes.filter(~_is_short(min_words))
    halves = _halves(long_, min_words)
    shared = _shared(halves.select("k", "h1"), scratch)
    hits = halves.join(shared, "k", "left_semi").groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = scratch(hits, "hits")
    found = long_.select("h1", "h2", "first").join(hits, ["h1", "h2"])
    short = classes.filter(_is_short(min_words) & (F.col("n") >= min_words)).select("h1", "h2", "first", F.lit(0).alias("low"), F.col("n").alias("high"))
    return found.unionByName(short)


def _texts_of(lines: DataFrame, docs: DataFrame, doc_id: str, text: str, scratch=materialise) -> DataFrame:
    """``h1, h2, id, dg, pos, low, high, line``: each line's bytes, out of the document of its first place."""
    place = F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "low", "high")
    asked = scratch(lines.groupBy(F.col("first.id").alias("id"), F.col("first.dg").alias("dg")).agg(F.collect_list(place).alias("asked")), "asked")
    found = _flat(docs, doc_id, text).join(asked, ["id", "dg"])
    at = found.withColumn("l", F.split(F.col("text").cast("string"), "\n")).select("id", "dg", "l", F.explode("asked").alias("x"))
    rows = at.select("x.h1", "x.h2", "id", "dg", "x.pos", "x.low", "x.high", F.get("l", F.col("x.pos")).cast("binary").alias("line"))
    return rows.dropDuplicates(["h1", "h2"])  # rows alike in id and text each have the line


def _variant_rows(lines: DataFrame) -> DataFrame:
    """``k, at, h1, h2, id, dg, pos``: at is -1 for the line itself, else the place of the deleted word."""
    names = ["k", "at", "h1", "h2", "id", "dg", "pos"]

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            low, high = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for begin in range(0, batch.num_rows, 256):  # a batch's lines as lists of words would be many times its size
                keys, at = [], []
                for i in range(begin, min(batch.num_rows, begin + 256)):
                    all_ = variants(batch.column(7)[i].as_py().lower().split())
                    keys.append(np.append(all_[:1], all_[1 + low[i] : 1 + high[i]]))
                    at.append(np.append([-1], np.arange(low[i], high[i])))
                of = np.repeat(np.arange(begin, begin + len(keys)), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32)), *[pa.array(c[of]) for c in cols]], names=names)

    return lines.select("h1", "h2", "id", "dg", "pos", "low", "high", "line").mapInArrow(run, "k long, at int, h1 long, h2 long, id long, dg long, pos int")


def near_matches(docs: DataFrame, classes: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``h1, h2`` of the distinct lines that an earlier line matches by one edit, as a written table. ``classes``: a written :func:`line_classes`."""
    scratch = Scratch()
    lines = scratch(_texts_of(open_lines(classes, min_words, scratch), docs, doc_id, text, scratch), "lines")
    every = _variant_rows(lines)
    shared = _shared(every.select("k", "h1"), scratch)
    rows = scratch(every.join(shared, "k", "left_semi"), "variants")
    order = F.struct("id", "dg", "pos")
    # a replacement: the earliest line of each (deletion, place); written, so that a hot key's rows can be split in the join
    deleted = rows.filter("at >= 0")
    earliest = deleted.groupBy("k", "at").agg(F.min(F.struct("id", "dg", "pos", "h1", "h2")).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "at", "e")
    earliest = scratch(earliest, "earliest")
    replaced = deleted.join(earliest, ["k", "at"]).filter(order > F.struct("e.id", "e.dg", "e.pos")).select("h1", "h2", "at", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"), F.col("at").alias("e_at"))
    # an insertion: the one line equal to a deletion of the others
    whole = rows.filter("at < 0").select("k", F.struct("id", "dg", "pos", "h1", "h2").alias("w"))
    inserted = deleted.join(whole, "k")
    later = F.struct("id", "dg", "pos") > F.struct("w.id", "w.dg", "w.pos")
    inserted = inserted.select(
        F.when(later, F.col("h1")).otherwise(F.col("w.h1")).alias("h1"), F.when(later, F.col("h2")).otherwise(F.col("w.h2")).alias("h2"), F.when(later, F.col("at")).otherwise(F.lit(-1)).alias("at"),
        F.when(later, F.col("w.h1")).otherwise(F.col("h1")).alias("e1"), F.when(later, F.col("w.h2")).otherwise(F.col("h2")).alias("e2"), F.when(later, F.lit(-1)).otherwise(F.col("at")).alias("e_at"))
    pairs = scratch(replaced.unionByName(inserted).distinct(), "pairs")
    # the hashes proposed the pairs; the words decide
    words = lines.select("h1", "h2", F.split(F.btrim(ascii_lower(F.col("line").cast("string")), F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("w"))
    pairs = pairs.join(words, ["h1", "h2"]).join(words.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("w").alias("e_w")), ["e1", "e2"])

    def without(w: str, at: str) -> str:
        return f"IF({at} < 0, {w}, concat(slice({w}, 1, {at}), slice({w}, {at} + 2, size({w}))))"

    near = pairs.filter(F.expr(f"{without('w', 'at')} = {without('e_w', 'e_at')}")).filter(F.least(F.size("w"), F.size("e_w")) >= min_words)
    near = materialise(near.select("h1", "h2").distinct(), "near_lines")
    scratch.drop()
    return near


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept lines in ``text``, and ``n_lines``, ``n_removed`` (lines with a word)."""
    classes = materialise(line_classes(docs, max(1, min_words), doc_id, text), "classes")
    near = near_matches(docs, classes, max(1, min_words), doc_id, text)
    stay = classes.join(near, ["h1", "h2"], "left_anti")
    places = stay.groupBy(F.col("first.id").alias("id"), F.col("first.dg").alias("dg")).agg(F.collect_list("first.pos").alias("kept"))
    own = F.col(text)
    out = boxed(docs, id=F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)), dg=F.xxhash64(F.coalesce(own, F.lit("")))).join(places, ["id", "dg"], "left")
    out = out.withColumn("text", F.col("row").getField(text))  # after the shuffle, which holds each text once
    out = out.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    out = out.withColumn("blank", F.expr("filter(transform(lines, (x, i) -> IF(btrim(x, ' \\t\\n\\u000b\\f\\r') = '', i, -1)), i -> i >= 0)"))
    out = out.withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    n_lines, kept = F.size("lines") - F.size("blank"), F.size("kept")
    rebuilt = F.expr("array_join(transform(array_sort(concat(kept, blank)), i -> lines[i]), '\\n')")
    cleaned = F.when(F.col("text").isNull() | (n_lines == kept), F.col("text")).when(kept == 0, F.lit("")).otherwise(rebuilt)
    return unboxed(out, docs, **{text: cleaned, "n_lines": n_lines.cast("long"), "n_removed": (n_lines - kept).cast("long")})
