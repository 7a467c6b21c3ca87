"""Title and abstract rows into embedding-ready text, with the reason for every abstract that was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.functions.hashing import xxh64_hex
from vecscore.functions.text import alpha_ratio, any_pattern, normal_space, strip_tags, without_title

# Thresholds of the modes and the default patterns, matched against the cleaned abstract in lower case.
MODES = {"lenient": (40, 0.30), "balanced": (80, 0.55), "strict": (120, 0.70)}
POLICIES = ("keep_title_only", "discard", "conditional")
PLACEHOLDERS = ["no abstract available", "abstract unavailable", "^not available$", "no summary available", "^n/?a$", "^none$"]
BOILERPLATE = ["copyright", "all rights reserved", "creative commons", "published by", "springer", "elsevier", "wiley", r"taylor\s*&\s*francis"]
HTML = [r"<\s*/?\s*(div|p|span|br|xml)[^>]*>", "&nbsp;", "&amp;", "xmlns"]
FLAGS = ("text_quality", "abstract_raw_present", "abstract_kept", "discard_reason", "cleaning_mode")
# A title that can stand alone.
TITLE_CHARS, TITLE_RATIO = 12, 0.6


@dataclass(frozen=True)
class CleanRules:
    """How to clean; ``None`` takes the mode's or the default value."""

    mode: str = "lenient"
    no_abstract_policy: str = "keep_title_only"
    min_chars: int | None = None
    min_alpha_ratio: float | None = None
    placeholder_patterns: list[str] | None = None
    boilerplate_patterns: list[str] | None = None
    html_patterns: list[str] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is unknown; there are {MODES}")
        if self.no_abstract_policy not in POLICIES:
            raise ValueError(f"no_abstract_policy {self.no_abstract_policy!r} is unknown; there are {POLICIES}")

    def limits(self) -> tuple[int, float]:
        chars, ratio = MODES[self.mode]
        return (chars if self.min_chars is None else self.min_chars, ratio if self.min_alpha_ratio is None else self.min_alpha_ratio)


def cleaned_columns(df: DataFrame, rules: CleanRules) -> DataFrame:
    """``df`` with every step beside it: cleaned title and abstract, the tests and the verdict."""
    chars, ratio = rules.limits()
    given = lambda own, default: default if own is None else own
    df = df.withColumns({"cleaned_title": normal_space(F.col("title")), "_raw": normal_space(F.col("abstract"))})
    df = df.withColumn("cleaned_abstract", without_title(strip_tags(F.col("_raw")), F.col("cleaned_title")))
    low = F.lower("cleaned_abstract")
    df = df.withColumns({
        "_n": F.length("cleaned_abstract"), "_ratio": alpha_ratio(F.col("cleaned_abstract")),
        "_missing": F.col("_raw") == "", "_empty": F.col("cleaned_abstract") == "",
        "_placeholder": any_pattern(low, given(rules.placeholder_patterns, PLACEHOLDERS)),
        "_boilerplate": any_pattern(low, given(rules.boilerplate_patterns, BOILERPLATE)),
        "_html": any_pattern(low, given(rules.html_patterns, HTML)),
    })
    short, twice = F.col("_n") < chars, F.col("_n") < 2 * chars
    # of several reasons the one that stands first is told
    told = F.when(F.col("_html") & twice, "html_artifact_short").when(F.col("_boilerplate") & twice, "boilerplate_short").when(F.col("_ratio") < ratio, "low_alpha_ratio").when(short, "too_short")
    told = told.when(F.col("_placeholder"), "placeholder").when(F.col("_empty"), "empty_after_clean").when(F.col("_missing"), "missing_abstract").otherwise("")
    df = df.withColumn("discard_reason", told)
    title_ok = (F.length("cleaned_title") >= TITLE_CHARS) & (alpha_ratio(F.col("cleaned_title")) >= TITLE_RATIO)
    no_abstract = {"keep_title_only": F.lit(True), "discard": F.lit(False), "conditional": title_ok}[rules.no_abstract_policy]
    kept = F.col("discard_reason") == ""
    text = F.when(kept, F.concat(F.lit("Title: "), "cleaned_title", F.lit("\nAbstract: "), "cleaned_abstract")).when(no_abstract, F.concat(F.lit("Title: "), "cleaned_title"))
    df = df.withColumns({"abstract_kept": kept, "abstract_raw_present": ~F.col("_missing"), "text": text, "cleaning_mode": F.lit(rules.mode)})
    quality = F.when(F.col("text").isNull(), "discarded").when(kept, "title_abstract").otherwise("title_only")
    return df.withColumn("text_quality", quality).drop("_raw", "_n", "_ratio", "_missing", "_empty", "_placeholder", "_boilerplate", "_html")


def clean_abstract_for_embedding(df: DataFrame, return_flags: bool = True, **options) -> DataFrame:
    """``id, text, text_hash`` and, unless turned off, the flags. Rows without id or text go."""
    missing = [c for c in ("id", "title", "abstract") if c not in df.columns]
    if missing:
        raise ValueError(f"the table to clean lacks {missing}")
    rules = CleanRules(**options)
    named = df.select(normal_space(F.col("id")).alias("id"), "title", "abstract").filter("id <> ''")
    out = cleaned_columns(named, rules)
    if rules.no_abstract_policy != "keep_title_only":
        # where every row keeps a text no such filter is made: pushed down, it would clean each text twice
        out = out.filter("text IS NOT NULL")
    return out.select("id", "text", xxh64_hex(F.col("text")).alias("text_hash"), *(FLAGS if return_flags else ()))


def parse_text(df: DataFrame) -> DataFrame:
    """``cleaned_title`` and ``cleaned_abstract`` read back from ``text``; null where its form is another."""
    mark = "\nAbstract:"
    titled = F.startswith(F.col("text"), F.lit("Title:"))
    at = F.instr("text", mark)
    title = F.when(at > 0, F.substring("text", 7, at - 7)).otherwise(F.substring("text", 7, F.length("text")))
    abstract = F.when(at > 0, F.substring("text", at + len(mark), F.length("text")))
    return df.withColumns({"cleaned_title": F.when(titled, F.trim(title)), "cleaned_abstract": F.when(titled, F.trim(abstract))})
