"""The pipeline's stages, one by one, against plain Python; mixing and packing by what they must keep."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import rows
from tests.llm.test_dedup import brute_lines, edited_lines, near_copies
from tests.llm.test_native import brute_quality, without_frequent
from tests.llm.test_shingles import all_pairs
from vecscore.llm import common, quality
from vecscore.llm.queries import tokenizer_files


def documents():
    docs = [(r[0], r[1], r[2], r[3], r[4]) for r in rows()]
    letters = lambda x: "".join(chr(97 + int(c)) for c in str(x))  # noqa: E731  digits of lines are all one to the quality rules
    docs += [(i, t + "\n" + " ".join(f"tail{letters(i)}x{letters(k)}" for k in range(60)), "en", f"s{i % 4}", len(t)) for i, t in edited_lines()]
    return docs + [(i, t, "de", "s9", len(t)) for i, t in near_copies(30)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs, kept = common.read(spark, folder, "documents"), [(d[0], d[1], d[3]) for d in documents()]
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialise(stage(spark, docs, folder), name)
        out[name] = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == list(common.DOCUMENT_COLUMNS)
            assert all(r[4] == (None if r[1] is None else len(r[1])) or name in ("near_dedup", "mix_sources") for r in out[name])
    # 1: rejected documents go, and lines above their host's limit
    verdict = {(i, ok) for (i, *_, ok) in brute_quality(kept, quality.LineLimits())}
    good = {i for i, ok in verdict if ok}
    first = sorted(((d, t) for d, t, _ in without_frequent(kept, quality.LineLimits()) if d in good), key=str)
    assert sorted(((r[0], r[1]) for r in out["quality_rules"]), key=str) == first
    assert any(t != dict((d[0], d[1]) for d in documents())[i] for i, t in first)
    # 2: lines
    assert sorted(((r[0], r[1]) for r in out["line_dedup"]), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(first)), key=str)
    # 3: one of each group at a similarity of 0.8 of five-word shingles, by all pairs
    assert sorted(r[0] for r in out["near_dedup"]) == all_pairs([(r[0], r[1]) for r in out["line_dedup"]])
    # 4: rows of the stage before, at most twice each
    before, after = {r[0]: r for r in out["near_dedup"]}, Counter(r[0] for r in out["mix_sources"])
    assert all(before[r[0]] == r for r in out["mix_sources"]) and max(after.values()) <= 2
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert words(out["mix_sources"]) == pytest.approx(1.5 * words(out["near_dedup"]), rel=0.2)
    # 5: every row packed whole, once for each time it is there
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_files()["vocabulary"])
    want = Counter()
    for r in out["mix_sources"]:
        ids = np.array([*slow.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want.update((r[0], a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False))
    copies = Counter((r[0], r[1], r[7]) for r in out["best_fit_packing"])
    assert max(copies.values()) == 1 and any(c == 1 for *_, c in copies)  # (doc_id, piece, copy) tells every piece
    for i, times in after.items():
        assert {c for j, _, c in copies if j == i} == set(range(times))
    got, seqs = Counter((r[0], r[2], r[3], r[4]) for r in out["best_fit_packing"]), defaultdict(list)
    assert got == want
    for r in out["best_fit_packing"]:
        seqs[r[5]].append((r[6], r[3]))
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)]))[:-1] and sum(n for _, n in own) <= 2048


def test_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    common.read(spark, folder, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
