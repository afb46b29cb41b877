import random

import pytest

from bytefold.llm import graph


def brute(links):
    root = {}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a), root.setdefault(b, b)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def found(spark, links, few=graph.FEW):
    rows = graph.components(spark.createDataFrame(links, "a long, b long").repartition(3), few=few).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["root"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(150)]
    links += [(x, x) for x in range(300, 310)] + [(None, 5), (6, None), (None, None)] + links[:20] + [(b, a) for a, b in links[:20]]
    assert found(spark, links, few=0 if seed == 1 else graph.FEW) == brute(links)


def test_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(1000, 1200)]
    hub = [(5000, 5000 + i) for i in range(1, 400)] + [(1, 5399)]
    got = found(spark, path + hub)
    assert got == brute(path + hub) and got[1200] == 1000 and got[5000] == 1


def test_nothing_links(spark):
    assert found(spark, [(4, 4), (None, 1)]) == {}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
