"""License scans, chat formatting and quality rules against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.conftest import rows
from vecscore.llm import chat, licenses, quality

SPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_license_places_and_labels(spark, odd, none):
    got = sorted(map(tuple, licenses.license_scan(odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    want = []
    for row in rows():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(row[1]))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((row[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)
    found = {r["doc_id"]: r for r in licenses.license_scan(odd).collect()}
    assert found[0]["labels"] == "mit,mit-terms" and found[2]["labels"] == "apache,apache-2.0" and found[6]["labels"] == "" and found[6]["score"] == 0
    assert licenses.license_scan(none).count() == 0


def brute_blocks(text):
    """Every block of every template, by all starts: (label, start, end, share)."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    out = set()
    for label, must, never, wording in licenses.TEMPLATES:
        tokens, size = set(wording.split()), licenses.block_length(wording.split())
        for k in range(len(w)):
            block = set(w[k : k + size])
            if w[k] in tokens and len(block & tokens) >= 0.8 * len(tokens) - 1e-9 and set(must.split()) <= block and not set(never.split()) & block:
                out.add((label, k, min(len(w), k + size), round(len(block & tokens) / len(tokens), 9)))
    return out


def test_license_blocks_are_those_of_all_starts(spark):
    texts = []
    for k in range(60):
        base = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][3].split()
        words = [f"z{k}{i}" for i in range(7 * k % 90)] + [w if (i + k) % (3 + k % 9) else f"q{i}" for i, w in enumerate(base)] + [f"y{i}" for i in range(k)]
        texts.append((k, " ".join(words)))
    texts += [(100, " ".join(x[3] for x in licenses.TEMPLATES)), (101, None), (102, "license " * 5000)]
    _, blocks = licenses.license_blocks(spark.createDataFrame(texts, "doc_id long, text string"), phrases={})
    got = defaultdict(set)
    for r in blocks.collect():
        got[int(r["_id"])].add((r["label"], r["start"], r["end"], round(r["share"], 9)))
    assert got == {k: found for k, t in texts if (found := brute_blocks(t))} and len(got) > 20


def labels_of(spark, texts):
    return [r["labels"] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_rival_labels(spark):
    wordings = dict((label, wording) for label, _, _, wording in reversed(licenses.TEMPLATES))
    cases = {
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-NC-SA 4.0": "cc-by",
        "This work is licensed under the GNU General Public License version 2": "gpl", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        wordings["lgpl-any"]: "lgpl-any", wordings["agpl-any"]: "agpl-any", wordings["gpl-any"]: "gpl,gpl-any", wordings["cc-by-4.0"]: "cc-by-4.0", wordings["cc-by-sa-4.0"]: "cc-by-sa-4.0",
        wordings["isc"]: "isc", wordings["mpl-2.0"]: "mpl-2.0", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0", "Released under the MIT License.": "mit,mit-terms",
        # the words of a notice scattered in another text
        "The album was released in May under a new name. Its license is the Apache License, they say, and nobody under the age of nine may play it": "apache",
        "Under the stars the license of the driver was released": "", "released " + "filler " * 5 + "under the mit license": "mit,mit-terms",
    }
    assert labels_of(spark, list(cases)) == list(cases.values())


def test_odd_rows_of_a_license_scan(spark):
    rows_ = [(1, "mit license", "x", 1, "y"), (1, "mit license", "x", 1, "y"), (1, "cc by", "z", 2, "y"), (None, "mit license", "x", 1, "y"), (None, None, None, None, None)]
    got = licenses.license_scan(spark.createDataFrame(rows_, "doc_id long, text string, labels string, _w int, _known string"))
    assert sorted(((r["doc_id"], r["base_labels"], r["n_base"]) for r in got.collect()), key=str) == sorted([(1, "mit", 1), (1, "mit", 1), (1, "cc-by", 1), (None, "mit", 1), (None, "", 0)], key=str)


CONTROL = ["", "hi", "<|im_end|>", "<|im_start|>assistant\nx", "\\", "\\|", "<\\|", "<|", "a\\<|b\\\\|", "\n", "naïve 名前", "x" * 300]


def plain(turns):
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    by = defaultdict(list)
    for t in turns:
        by[t[0]].append(t)
    out = {}
    for c, own in by.items():
        own = sorted(own, key=key)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, None]), st.sampled_from(["user", "assistant", "system", None, "odd\nrole\\n", "<|im_start|>"]), st.sampled_from([*CONTROL, None])), min_size=1, max_size=14), st.sampled_from([5, 12, 1000]), st.sampled_from([0, 1, 3]))
def test_chat_reads_back(spark, turns, budget, history):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df, budget, history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(windows)).collect()}
    assert got == plain(turns)


def test_chat_windows_keep_the_budget(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", " ".join(["word"] * (k % 7 + 1))) for k in range(1, 60)]
    row = chat.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 40, 2).first()
    assert len(row["windows"]) > 3
    for k, w in enumerate(row["windows"]):
        assert w["tokens"] <= 40 and w["text"].startswith("<|im_start|>system\nbe kind<|im_end|>")
        assert k == 0 or w["repeated"] >= 1
        for span in w["spans"]:
            before = w["text"][: span["start"]]
            assert before.endswith("<|im_start|>assistant\n") and w["text"][span["start"] + span["length"] :].startswith("<|im_end|>")
    assert chat.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_and_turns(spark):
    """30,000 turns, a turn far beyond the budget, and columns named as the operator's own; in time that follows the number of turns."""
    import time

    many = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('word ', id, ' and ', id * 7) AS text", "1 AS n", "'x' AS p", "2 AS i", "'y' AS _t")
    long_ = spark.createDataFrame([(8, 0, "system", "be kind", 1, "x", 2, "y"), (8, 1, "user", "word " * 50_000, 1, "x", 2, "y"), (8, 2, "assistant", "ok", 1, "x", 2, "y")], many.schema)
    began = time.time()
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.chat_windows(many.unionByName(long_)))).collect()}
    assert time.time() - began < 60
    turns = [(7, k, "user" if k % 2 == 0 else "assistant", f"word {k} and {k * 7}") for k in range(30_000)] + [(8, 0, "system", "be kind"), (8, 1, "user", "word " * 50_000), (8, 2, "assistant", "ok")]
    want = plain(turns)
    for c in (7, 8):
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want[c]
    # a turn has 4 words and 3 marks: 146 fill a window, of which two are repeated from the second window on
    assert got[7]["n_windows"] == -(-30_000 // 146) and got[8]["n_windows"] == 3


def norm(line):
    return re.sub("[0-9]+", "0", " ".join(SPACE.findall(line.lower())))


def line_counts(docs):
    """The distinct texts of each host, and those that hold each of its lines."""
    hosts, held = defaultdict(set), defaultdict(set)
    for _, t, s in docs:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                held[(s, norm(line))].add(t or "")
    return hosts, held


def without_frequent(docs, limits):
    hosts, held = line_counts(docs)
    frequent = lambda x, s: norm(x) and len(held[(s, norm(x))]) > max(limits.floor, limits.share * len(hosts[s]))
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not frequent(x, s)), s) for i, t, s in docs]


def brute_quality(docs, limits):
    hosts, held = line_counts(docs)
    out = []
    for i, t, s in docs:
        w = SPACE.findall(t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(grams)
        rep = len({j for k, g in enumerate(grams) if count[g] > 1 for j in range(k, k + 8)})
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        gone = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if norm(x) and len(held[(s, norm(x))]) > max(limits.floor, limits.share * len(hosts[s])))
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        empty = gone > 0 and len(w) - gone < limits.min_words and len(w) - gone <= limits.min_kept_share * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, gone, failed, not failed and not empty))
    return sorted(out, key=str)


def test_quality_is_that_of_plain_python(spark, odd, none):
    limits = quality.LineLimits(floor=1, share=0.1)
    more = [(100 + k, "\n".join(["Boilerplate of 10 words that every page of this host repeats", f"own line number {k} " + "ab cd " * (k % 4), "a | b * c"] * (1 + k % 2)), "hot") for k in range(12)]
    docs = [(r[0], r[1], r[3]) for r in rows()] + more
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = quality.quality_rules(df, limits).select("doc_id", *quality.FEATURES, "removed_words", "base_failed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute_quality(docs, limits)
    kept = quality.without_frequent_lines(odd, quality.quality_rules(odd))
    assert kept.columns == odd.columns and kept.count() == sum(r[-1] for r in brute_quality([(r[0], r[1], r[3]) for r in rows()], quality.LineLimits()))
    assert quality.quality_rules(none).count() == 0


def test_copies_of_one_text_are_no_boilerplate(spark):
    text = " ".join(f"clean{k}" for k in range(30))
    df = spark.createDataFrame([(k, text, "s") for k in range(20)], "doc_id long, text string, source string")
    assert quality.quality_rules(df, quality.LineLimits(floor=2, share=0.0)).filter("kept").count() == 20
