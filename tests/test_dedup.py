"""Greedy dedup by either of two keys against its definition."""

import random
from pathlib import Path

import pytest

from weftline.operators import dedup
from weftline.operators.components import components
from weftline.operators.tables import Tables, shared_dir


def greedy(rows):
    a, b, kept = set(), set(), []
    for o, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            kept.append(o)
    return kept


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "n long, id string, title string, component string")


@pytest.mark.parametrize("seed,fold_rows", [(0, 10**6), (1, 0), (2, 6)])
def test_greedy_equals_its_definition(spark, seed, fold_rows):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *map(str, range(60))]), r.choice([None, "", *map(str, range(90))])) for i in r.sample(range(10_000), 150)]
    rows += [(20_000 + i, f"u{i}", f"v{i % 7}") for i in range(40)] + [(30_000 + i, "hot", "hot") for i in range(50)]
    out = dedup.greedy_either(frame(spark, rows), "n", "id", "title", fold_rows)
    assert sorted(x.n for x in out.collect()) == greedy(rows) and out.columns == ["n", "id", "title", "component"]
    assert dedup.greedy_either(frame(spark, []), "n", "id", "title").collect() == []


def test_a_long_chain_takes_a_few_rounds(spark, monkeypatch):
    """10,000 rows, of which each shares one key with the row before it: rounds alone would decide one row in two of a round's each."""
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(10_000)]
    written = []
    put = Tables.put
    monkeypatch.setattr(Tables, "put", lambda self, df: written.append(1) or put(self, df))
    out = dedup.greedy_either(frame(spark, rows).repartition(7, "n"), "n", "id", "title")
    assert sorted(x.n for x in out.collect()) == greedy(rows)
    assert len(written) < 20


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(500)] + [(-5, 2000 + i) for i in range(50)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    got = components(spark.createDataFrame(links, "u long, v long").repartition(9), Tables(spark, "t")).collect()
    assert {x.node: x.component for x in got} == {x: find(x) for e in links for x in e if e[0] != e[1]} and len(got) == len({x.node for x in got})


def test_tables_are_dropped(spark):
    rows = [(i, f"a{i // 3}", f"b{i // 2}") for i in range(100)]
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("greedy-*"))
    dedup.greedy_either(frame(spark, rows), "n", "id", "title", 0).collect()
    (new,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("greedy-*")) - before
    left = {p.name for p in new.iterdir()}
    assert len(left) < 30 and all("1" != x for x in left)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *_: None)
    on = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(on(master))
    assert shared_dir(on("local[4]")).startswith("file://")
