"""Quality rules [native]: per-document rules and cross-document line frequency.

Every line is normalised and hashed to 128 bits. For each host (the ``source``
column) the distinct texts that hold a line are counted; exact copies of one text
count once, so a copied document isn't taken for boilerplate. Lines above the
host's limit are removed. A document is rejected if a base rule fails, or if it is
depleted: few words stay and most of them were removed.

Defined results: a null text has no words and fails the base rule; a null source
is a host of its own; a null doc_id is an id; rows alike in id, host and text get equal
results, one each; a line held by exactly the limit stays; very long texts are counted
whole, in one row; an empty table gives an empty table; other columns, whatever their
names, are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import SPACES, Scratch, boxed, materialise, space_words, unboxed

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LineLimits:
    """A line of a host goes if more than max(floor, share of the host's texts) distinct texts hold it.

    The floor says how few texts are no evidence of boilerplate; from floor / share = 150 texts on the share alone decides.
    """

    floor: int = 3
    share: float = 0.02
    #: Depleted: fewer than this many words stay, and no more than this share of them.
    min_words: int = 20
    min_kept_share: float = 0.3


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base counts and ``base_failed``.

    Repeated 8-word windows are first looked for by a hash; a text that has any is
    then counted by the windows' own words, sorted with their places.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", space_words(F.col(text)))
    # each word is hashed once, a window as eight of these: little work and a shallow expression for each word
    out = out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    out = out.withColumn("_h", F.expr("IF(size(_h) < 9, array(), transform(sequence(1, size(_h) - 7), i -> xxhash64(slice(_h, i, 8))))"))
    out = out.withColumn("_rep", F.expr("size(array_distinct(_h)) < size(_h)"))
    out = out.withColumn("_s", F.expr("IF(_rep, array_sort(transform(sequence(0, size(_w) - 8), i -> struct(array_join(slice(_w, i + 1, 8), ' ') AS k, i AS i))), NULL)"))
    out = out.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, j) -> get(_s, j - 1).k <=> x.k OR get(_s, j + 1).k <=> x.k), x -> x.i))"))
    covered = F.expr("IF(_p IS NULL OR size(_p) = 0, 0L, aggregate(zip_with(slice(_p, 2, size(_p)), slice(_p, 1, size(_p) - 1), (a, b) -> least(8, a - b)), 8L, (s, x) -> s + x))")
    out = out.withColumn("_l", F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.drop("_w", "_h", "_rep", "_s", "_p", "_l")


def normal_line(line: Column) -> Column:
    """Lower case, single blanks, digits as one 0. Only white space other than a single blank is rewritten."""
    single = F.regexp_replace(F.lower(line), r"\x20*+[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}", " ")
    return F.btrim(F.regexp_replace(single, "[0-9]+", "0"), F.lit(" "))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _keyed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """``doc_id, text, _id, _host, _digest``: rows alike in the last three have like lines removed."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id), F.lit(-1)).alias("_id"), _host(F.col(host)).alias("_host"), _digest(text).alias("_digest"),
    )


def _line_rows(keyed: DataFrame) -> DataFrame:
    """One row per non-blank line: its place, 128-bit hash and words."""
    lines = keyed.select("_id", "_host", "_digest", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_pos", "_line"))
    # blank lines go by a cheap test: a filter on the normal form would work it out twice
    lines = lines.filter(F.btrim("_line", F.lit(SPACES)) != "").withColumn("_norm", normal_line(F.col("_line")))
    return lines.select("_id", "_host", "_digest", "_pos", F.xxhash64("_norm").alias("_h1"), F.xxhash64(F.lit("line"), "_norm").alias("_h2"), (F.octet_length("_norm") - F.octet_length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1).alias("_nw"))


def frequent_lines(keyed: DataFrame, line_rows: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """``_host, _h1, _h2, n_docs`` of the lines above their host's limit.

    Both counts are over distinct (host, text) pairs, first combined on the map
    side, so that neither a hot host nor a hot line meets in one task as raw rows.
    A host with D texts of k lines has at most k / share of such lines.
    """
    counts = line_rows.select("_host", "_h1", "_h2", "_digest").distinct().groupBy("_host", "_h1", "_h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > limits.floor)
    hosts = keyed.select("_host", "_digest").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    return counts.join(hosts, "_host").filter(F.col("n_docs") > F.greatest(F.lit(float(limits.floor)), limits.share * F.col("_texts"))).select("_host", "_h1", "_h2", "n_docs")


_KEY = ["_id", "_host", "_digest"]


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row per row of ``docs``: its id, the base counts, ``removed_words``, ``removed_lines`` (their places), ``base_failed`` and ``kept``.

    The lines' hashes are written once, for the counts and for the search of frequent
    lines. The base counts are written before anything is filtered by them: an optimizer
    that pushed such a filter down would count the windows of each text again and again.
    """
    keyed = _keyed(docs, doc_id, text, host)
    scratch = Scratch()
    line_rows = scratch(_line_rows(keyed), "line_rows")
    over = scratch(frequent_lines(keyed, line_rows, limits), "frequent_lines")
    hits = line_rows.join(over, ["_host", "_h1", "_h2"])
    removed = hits.select(*_KEY, "_pos", "_nw").distinct().groupBy(*_KEY).agg(F.sum("_nw").alias("removed_words"), F.array_sort(F.collect_list("_pos")).alias("removed_lines"))
    removed = materialise(removed, "removed")
    scratch.drop()
    features = document_features(keyed)
    features = materialise(features.select("doc_id", *_KEY, *FEATURES, "base_failed"), "features")
    out = features.join(removed, _KEY, "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (left < limits.min_words) & (left <= limits.min_kept_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_frequent_lines(docs: DataFrame, ruled: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, their frequent lines taken out of ``text``."""
    kept = ruled.filter("kept").select(*_KEY, F.col("removed_lines").alias("gone")).dropDuplicates(_KEY)
    own = {"_id": F.coalesce(F.col(doc_id), F.lit(-1)), "_host": _host(F.col(host)), "_digest": _digest(text)}
    joined = boxed(docs, **own).join(kept, _KEY).withColumn("text", F.col("row").getField(text))  # the shuffle holds each text once
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return unboxed(joined, docs, **{text: cleaned})
