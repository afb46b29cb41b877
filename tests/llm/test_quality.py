import random
import re

from bytefold.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, x in enumerate(five) if five.count(x) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def texts():
    r = random.Random(7)
    words = ["the", "of", "été", "a|b", "<x>", "W", "stone", "$5", "\x00\x01"]
    out = [r.choice(["", " ", "\n"]).join(r.choice(words) + r.choice([" ", "  ", "\n", "\t\r\n"]) for _ in range(r.randrange(0, 60))) for _ in range(150)]
    return [*out, None, "", " \n\t", "one", "x " * 20_000, "\x0b\x0c y", "line\nline\n  \nline"]


def test_counts_against_brute_force(spark):
    rows = [(i, t, 5, "k") for i, t in enumerate(texts())] + [(3, texts()[3], 5, "k"), (None, "the same old words", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, q_ int, n_words string")
    got = quality.report(df).collect()
    assert len(got) == len(rows)
    want = {d: brute(t) for d, t, _, _ in rows}
    for r in got:
        if r["n_words"] < 5000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]]
        else:
            assert r["n_repeat_words"] == r["n_words"] == 20_000
        assert not (r["kept"] and r["base_failed"])
    kept = quality.accepted(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["kept"] for r in got)
    assert quality.report(df.limit(0)).collect() == []


def test_rules(spark):
    good = "the house of the river and the old stone in a valley that is near to us by the wood was for all"
    rows = [(1, " ".join(f"{w}{i}" if w == "old" else w for i in range(4) for w in good.split()).replace("river", "r").replace("that", "t")), (2, " ".join(f"w{i}###" for i in range(60))), (3, " ".join(f"zq{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    strict = [*quality.RULES, quality.Rule("n_lines", 2, None)]
    assert {r["doc_id"] for r in quality.report(df).where("kept").collect()} <= {1}
    assert quality.report(df, rules=strict).where("kept").count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.report(df.selectExpr("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
