import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecscore.llm import urls


def as_regex(p: bytes):
    out, i = b"", 0
    while i < len(p):
        if p[i : i + 2] == b"**":
            out, i = out + b"(?s:.)*", i + 2
        elif p[i : i + 1] == b"*":
            out, i = out + b"[^\x01\x02]*", i + 1
        else:
            out, i = out + re.escape(p[i : i + 1]), i + 1
    return re.compile(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*\x01", max_size=40).map(str.encode), min_size=1, max_size=12), st.lists(st.text("ab\x01", max_size=30).map(str.encode), min_size=1, max_size=8))
def test_all_patterns_at_once_are_each_alone(patterns, texts):
    got = urls.simulate(urls.compile_globs(patterns), texts)
    want = [[as_regex(p).fullmatch(t) is not None for p in patterns] for t in texts]
    assert got.tolist() == want


@pytest.mark.parametrize("url,want", [
    ("http://A.B.com/x?y#z", ("a.b.com", "/x", "?y#z")),
    ("https://h#f", ("h", "", "#f")),
    ("no scheme", ("", "", "")),
    (None, ("", "", "")),
    ("http://", ("", "", "")),
    ("a://b?c/d", ("b", "", "?c/d")),
])
def test_parts(url, want):
    assert urls.parts_of(url) == want
