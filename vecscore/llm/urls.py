"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob rule is a row of positions; all rules lie end to end in words of 64
bits. For each byte of a URL, one shift, one and with the byte's mask, and one
or with the stars that keep a position, step all rules at once (Shift-And). A batch
of URLs is stepped together, column by column, longest first, so each step works
on the URLs that still have a byte there.

Canonical URL: ``.host``, a host mark, the path, a query mark and the rest, as UTF-8
bytes. Rules: ``*`` stands for any bytes but the marks, ``**`` for any bytes at all.
A host rule is ``**.host`` before the host mark, so it fits the host itself and all
subdomains. Of the rules of the given list that match, the longest (host and path)
wins; a URL that none fits is judged by the pattern rules, the method's own.

Defined results: a null or empty URL or one without ``://`` has an empty host and path, fits
no rule and is blocked; equal URLs get equal results, repeated rows one each; of rules of
equal length that fit, the first by their text wins; URLs of any length are stepped through
whole, byte by byte, beside the others of their batch; an empty table gives an empty table;
the result has its own columns alone, and others of ``pages`` are not read, so no name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST_MARK, QUERY_MARK = b"\x01", b"\x02"
#: The rules of the contract (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The method's own patterns, over the canonical URL; its part after the query mark is in lower case.
PATTERNS = [
    "**\x01**/login**", "**\x01**/signin**", "**\x01**/cart**", "**\x01**/checkout**", "**\x01**/wp-admin**",
    "**\x01*.exe", "**\x01*.zip", "**\x01*.apk", "**\x01*.exe\x02**", "**\x01*.zip\x02**",
    "**\x02**sessionid=**", "**\x02**phpsessid=**", "*.xxx\x01**", "*.porn\x01**", "*.casino\x01**",
]


@dataclass(frozen=True)
class Automaton:
    """Masks of all patterns end to end: byte masks, stars, starts and ends."""

    words: int
    step: np.ndarray  # (256, words): positions that a byte may enter
    stay: np.ndarray  # (256, words): positions that a star keeps on a byte
    first: np.ndarray
    last: np.ndarray  # (patterns,): the bit position after which a pattern has matched


def compile_globs(patterns: list[bytes]) -> Automaton:
    """A position for each byte of a pattern, and one for its end."""
    step, stay, first, last = [], [], [], []
    marks = {HOST_MARK[0], QUERY_MARK[0]}
    for pattern in patterns:
        first.append(len(step))
        i, pending = 0, set()
        # a position waits for its byte; the stars before it keep it waiting
        while i <= len(pattern):
            if i < len(pattern) and pattern[i : i + 1] == b"*":
                wide = pattern[i : i + 2] == b"**"
                pending |= set(range(256)) - (set() if wide else marks)
                i += 2 if wide else 1
                continue
            stay.append(pending)
            pending = set()
            step.append({pattern[i]} if i < len(pattern) else set())
            i += 1
        last.append(len(step) - 1)
    words = -(-len(step) // 64)

    def pack(sets: list[set[int]]) -> np.ndarray:
        out = np.zeros((256, words), dtype=np.uint64)
        for k, own in enumerate(sets):
            for b in own:
                out[b, k // 64] |= np.uint64(1 << k % 64)
        return out

    start = np.zeros(words, dtype=np.uint64)
    for k in first:
        start[k // 64] |= np.uint64(1 << k % 64)
    return Automaton(words, pack(step), pack(stay), start, np.array(last))


def simulate(auto: Automaton, texts: list[bytes]) -> np.ndarray:
    """(texts, patterns): which patterns match which whole texts."""
    n = len(texts)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8) if n else np.zeros(0, np.uint8)
    begin = (np.cumsum(length) - length)[order]
    ordered = length[order]
    state = np.tile(auto.first, (n, 1))
    one, top = np.uint64(1), np.uint64(63)
    live = n
    for column in range(int(ordered[0]) if n else 0):
        while live and ordered[live - 1] <= column:
            live -= 1
        byte = flat[begin[:live] + column]
        now = state[:live]
        hit = now & auto.step[byte]
        moved = hit << one
        if auto.words > 1:  # the bit that leaves a word enters the next
            moved[:, 1:] |= hit[:, :-1] >> top
        state[:live] = moved | (now & auto.stay[byte])
    done = (state[:, auto.last // 64] >> (auto.last % 64).astype(np.uint64)) & one
    out = np.zeros((n, len(auto.last)), dtype=bool)
    out[order] = done.astype(bool)
    return out


def parts_of(url: str | None) -> tuple[str, str, str]:
    """Host in lower case, path, and what follows."""
    if url is None or (at := url.find("://")) < 0:
        return "", "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, rest[:cut], rest[cut:]


def _glob_text(text: str) -> bytes:
    """Marks inside a URL would end its parts early: they are written as %01 and %02."""
    return text.encode("utf-8", "surrogatepass").replace(HOST_MARK, b"%01").replace(QUERY_MARK, b"%02")


def url_filter(pages: DataFrame, rules=None, own_patterns: list[str] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``."""
    rules = RULES if rules is None else rules
    own_patterns = PATTERNS if own_patterns is None else own_patterns
    # longest first: the first match wins
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    given = [b"**." + r[1].encode() + HOST_MARK + r[2].encode() + b"**" for r in ranked]
    auto = compile_globs(given + [p.encode() for p in own_patterns])
    names = [r[1] + r[2] for r in ranked]
    says = [r[0] for r in ranked]
    k = len(ranked)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                split = [parts_of(u) for u in part.column(1).to_pylist()]
                texts = [b"." + _glob_text(h) + HOST_MARK + _glob_text(p) + (QUERY_MARK + _glob_text(q.lower()) if q else b"") for h, p, q in split]
                matched = simulate(auto, texts)
                which = np.where(matched[:, :k].any(axis=1), matched[:, :k].argmax(axis=1), -1) if k else np.full(len(texts), -1)
                bad = matched[:, k:].any(axis=1)
                rule = [names[i] if i >= 0 else None for i in which]
                verdict = [says[i] if i >= 0 else "block" if b or not h else "allow" for i, b, (h, _, _) in zip(which, bad, split, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in split], pa.string()), pa.array([x[1] for x in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
