"""Quality rules with the production limits on small and large hosts."""

from tests.llm.test_native import brute_quality
from vecscore.llm import quality


def test_production_limits_decide_by_share(spark):
    def host(name, n, held, at):
        menu = " ".join(f"menu{name}{k}" for k in range(60))
        letters = lambda d: "".join(chr(97 + int(x)) for x in str(d))  # noqa: E731  digits would all become one 0
        own = [" ".join(f"{name}{letters(d)}v{chr(97 + k)}" for k in range(25 if d % 2 else 19)) for d in range(n)]
        return [(at + d, own[d] + (f"\n{menu}" if d < held else ""), name) for d in range(n)]

    docs = host("all", 40, 40, 0) + host("fifth", 50, 11, 1000) + host("few", 8, 8, 2000) + host("three", 3, 3, 5000) + host("rare", 600, 12, 3000) + host("common", 600, 13, 4000)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    ruled = quality.quality_rules(df)
    got = sorted(map(tuple, ruled.select("doc_id", *quality.FEATURES, "removed_words", "base_failed", "kept").collect()), key=str)
    assert got == brute_quality(docs, quality.LineLimits())
    gone = [r["doc_id"] // 1000 for r in ruled.filter("removed_words > 0").collect()]
    assert [gone.count(k) for k in range(6)] == [40, 11, 8, 0, 13, 0]
    assert {r["doc_id"] for r in ruled.filter("NOT kept AND NOT base_failed AND doc_id < 1000").collect()} == set(range(0, 40, 2))
