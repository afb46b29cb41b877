import os
import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    before = docs
    for name, stage in pipeline.STAGES:
        after = pipeline.workspace.keep(stage(spark, before, SF), "t")
        seen[name] = (before, after)
        if name != "best-fit packing":
            assert after.columns == columns, name
        before = after
    a, b = seen["quality rules"]
    kept = {r["doc_id"] for r in pipeline.quality.report(a).where("kept").collect()}
    assert {r["doc_id"] for r in b.collect()} == kept and len(kept) < a.count()
    a, b = seen["SimHash near-dedup"]
    assert b.count() < a.count() and b.select("text").distinct().count() == b.count()
    a, b = seen["secret scans"]
    secret = """text rlike 'AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}|token = "[0-9a-fA-F]{40}"'"""
    assert a.count() == b.count() and b.where("text like '%<SECRET>%'").count() >= a.where(secret).count()
    assert not b.where(secret).count()
    a, b = seen["mixing to target weights"]
    assert not {r["doc_id"] for r in a.collect()} - {r["doc_id"] for r in b.collect()} and b.count() >= a.count()
    a, b = seen["best-fit packing"]
    assert {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in b.collect()}
    assert b.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert pipeline.run(spark, SF).count() == b.count()


KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, copies int, tokens string, component long, slice int"


def prose(seed, n=200):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to"]) if i % 3 == 0 else "".join(r.choice("abcdefghij") for _ in range(6)) for i in range(n))


def stages(spark, folder, rows, labels):
    """The rows after each stage, by stage, of a folder with these documents."""
    folder = str(folder)
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.workspace.keep(stage(spark, docs, folder), "t")
        if name != "best-fit packing":
            assert docs.columns == columns, name
        out[name] = [r.asDict() for r in docs.collect()]
    return out


def test_awkward_rows(spark, tmp_path):
    extra = ("r", "i", 7, "t", -1, 3)
    twin, long = prose(1), prose(2, 60_000)
    rows = [
        (1, None, "en", "a", None, *extra),
        (2, "", "en", "a", 0, *extra),
        (3, twin, "en", "a", 9, *extra),
        (3, twin, "en", "a", 9, *extra),
        (4, twin, None, None, None, *extra),
        (None, twin, "de", "b", 9, *extra),
        (None, prose(3), None, None, None, None, None, None, None, None, None),
        (5, long, "fr", "b", 9, *extra),
        (6, prose(4) + " password=0123456789abcdef01", "es", "b", 9, *extra),
        *[(10 + i, prose(100 + i), "de en es fr".split()[i % 4], "c", 9, *extra) for i in range(40)],
    ]
    got = stages(spark, tmp_path, rows, [(10 + i, 1, 0) for i in range(40)] + [(None, None, None)])
    ids = {name: [r.get("doc_id") for r in found] for name, found in got.items()}
    assert not {1, 2} & set(ids["quality rules"]) and len(ids["quality rules"]) == len(rows) - 2
    texts = [r["text"] for r in got["SimHash near-dedup"]]
    assert sorted(texts) == sorted({r[1] for r in rows if r[1]})  # one of each text, whole
    clean = got["secret scans"]
    assert len(clean) == len(texts) and [r["text"][-8:] for r in clean if r["doc_id"] == 6] == ["<SECRET>"]
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    key = lambda r: (str(r["doc_id"]), r["text"], r["copies"], r["component"])
    assert {key(r) for r in got["mixing to target weights"]} == {key(r) for r in clean}
    packed = got["best-fit packing"]
    assert set(ids["best-fit packing"]) == {r["doc_id"] for r in clean}
    assert max(r["piece"] for r in packed if r["doc_id"] == 5) > 10
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_empty_table_and_no_labels(spark, tmp_path):
    assert not any(stages(spark, tmp_path / "empty", [], []).values())
    one = stages(spark, tmp_path / "one", [(1, prose(5), "en", "a", 9, *[None] * 6)], [])
    assert all({r["doc_id"] for r in found} == {1} for found in one.values())
