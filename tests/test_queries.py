import re

import pytest
from oracle import connect, rows_of, sql_rows

from weftline.plans import detail_queries, stream_queries  # noqa: F401  they register their queries
from weftline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(tables, ORACLE_SQL[name])


def test_coerce_values_covers_all_parts(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.p_partkey: (r.number, r.whole, r.clock) for r in QUERIES["coerce_values"](spark, sf).collect()}
    want = {}
    for (i,) in connect(sf).sql("SELECT p_partkey FROM part").fetchall():
        h, m, s = i // 3600, i // 60 % 60, i % 60
        want[i] = (None if i % 5 == 0 else i + i % 2 * 0.5, None if i % 5 == 0 else float(i), f"{h:02}:{m:02}:{s:02}" if h else f"{m:02}:{s:02}")
    assert max(want) > 3600 and got == want


def test_compose_manifest_covers_all_orders(spark, tables):
    lines = tables.sql("SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice").fetchall()
    brands = {}
    for o, b in lines:
        brands.setdefault(o, []).append(re.sub("[^0-9A-Za-z_]", "_", b))
    want = {o: (len(bs), ",".join(f"{b}{f'_{i + 1}' if b in bs[:i] else ''}_properties_and_telemetries" for i, b in enumerate(bs))) for o, bs in brands.items()}
    got = {r.query_id: (r.parts, r["keys"]) for r in QUERIES["compose_manifest"](spark, SF).collect()}
    assert len(got) > len({o for o in want if o % 50 == 0}) and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
