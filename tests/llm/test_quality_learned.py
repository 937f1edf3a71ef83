"""Documents far outside a tight group, each within every fixed number that rules like these commonly use."""

from pyspark.sql import functions as F

from corpusloom.llm import quality


def outliers(text):
    w = text(60, 2000).split()
    repeated = " ".join(w + w[:8])  # 16 of 68 words
    lines = [text(3, 3000 + i) for i in range(13)]
    doubled = "\n".join(lines + [lines[i] for i in (9, 3, 11, 0, 6, 1, 8)])  # 7 of 20 lines
    short = " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "xy"[: 1 + i % 2] for i in range(60))  # 3.5 characters a word
    marked = " ".join(x + "##" * (i % 8 == 0) for i, x in enumerate(text(60, 4000).split()))  # 4 % signs
    return {"repeat_share": (repeated, 0.15, 0.3), "dup_line_share": (doubled, 0.3, 0.4), "mean_word": (short, 3.0, 4.0), "symbol_share": (marked, 0.03, 0.05)}


def test_learned_fences_are_tighter_than_fixed_numbers(docs, text):
    odd = outliers(text)
    rows = {r.doc_id: r for r in quality.quality_rules(docs([text(60, i) for i in range(300)] + [x for x, _, _ in odd.values()])).collect()}
    assert all(rows[i].kept for i in range(300))
    for i, (name, (_, low, high)) in enumerate(odd.items()):
        r = rows[300 + i]
        assert low < r[name] < high and not r.base_failed and not r.kept, (name, r)


def test_loose_groups_keep_what_is_usual_there(docs, text):
    """A document that a tight group rejects stays where such values are usual."""
    doubled = outliers(text)["dup_line_share"][0]
    rows = quality.quality_rules(docs([text(60, i) for i in range(300)] + [doubled] * 300)).collect()
    assert len(rows) == 600 and all(r.kept for r in rows)


def test_fences_are_those_of_exact_quantiles(spark):
    """Within the sketches' rank error, per pair and where a small pair takes its language's."""
    import numpy as np

    r = np.random.default_rng(8)
    groups = {("en", "a"): r.gamma(3, 1, 4000), ("en", "b"): r.normal(20, 2, 5000), ("de", "a"): np.where(r.random(3000) < 0.8, 0.0, r.random(3000)), ("de", "few"): r.random(20)}
    rows = [(lang, source, False, *[float(v)] * 4) for (lang, source), x in groups.items() for v in x]
    names = "lang string, source string, base_failed boolean, " + ", ".join(f"{n} double" for n in quality.RATIOS)
    found = {(f.lang, f.source): f for f in quality.thresholds(spark.createDataFrame(rows, names)).collect()}
    groups["de", "few"] = np.concatenate((groups["de", "a"], groups["de", "few"]))
    for key, x in groups.items():
        least = quality.SPREAD["symbol_share"]

        def high(off):
            q = lambda p: np.quantile(x, min(max(p, 0), 1), method="lower")
            return max(q(1 - t + off) + by * max(q(1 - t + off) - q(0.5 - off), least) for t, by in quality.TAILS)

        assert high(-0.02) - 1e-9 <= found[key].symbol_share_high <= high(0.02) + 1e-9, key


def test_the_same_ratio_in_two_languages(docs, text):
    """4 % signs are usual in one language and not in the other."""
    marked = [" ".join(x + "##" * (i % 8 == 0) for i, x in enumerate(text(60, 4000 + j).split())) for j in range(250)]
    plain = docs([text(60, i) for i in range(300)] + marked[:1], lang="en")
    signs = docs(marked, lang="de").withColumn("doc_id", F.col("doc_id") + 1000)
    rows = {r.doc_id: r for r in quality.quality_rules(plain.unionByName(signs)).collect()}
    assert rows[300].symbol_share == rows[1000].symbol_share
    assert not rows[300].kept and rows[1000].kept
