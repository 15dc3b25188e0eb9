"""Each query against its SQL in DuckDB, on tables made here."""

import datetime as dt
import hashlib
import random

import duckdb
import pytest

import __spark_entry__ as entry
from seedloom import catalog, catalog_parts  # noqa: F401

WORDS = "amber basin cedar delta ember fable grove".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Small tables with the columns of the driver's."""
    r, d = random.Random(5), tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    rows = {
        "region": ("r_regionkey INTEGER, r_name VARCHAR", [(k, WORDS[k]) for k in range(5)]), "nation": ("n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER", [(k, "FRANCE" if k == 6 else f"N{k:02}", k % 5) for k in range(25)]),
        "customer": ("c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR", [(k, f"Customer#{k}", k % 25, round(r.uniform(-999, 9999), 2), r.choice(["BUILDING", "MACHINERY", "FURNITURE"])) for k in range(1, 151)]),
        "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE", [(k, f"S{k}", k % 25, 1.0) for k in range(40)]),
        "part": ("p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE", [(k, "x", "b", "t", r.randint(1, 50), round(r.uniform(1, 2000), 2)) for k in range(1, 81)]),
        "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", [(k, r.randint(1, 150), r.choice("FOP"), 1.5, dt.datetime(2024, 1, 1), r.choice(["1-URGENT", "4-NOT SPECIFIED", "5-LOW"])) for k in range(1, 301)]),
        "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
                     [(r.randint(1, 310), r.randint(1, 85), 1, r.randint(1, 7), float(r.randint(1, 50)), round(r.uniform(1, 9000), 2), r.randint(0, 10) / 100, 0.0, "A", "F", dt.datetime(2024, 2, 1)) for _ in range(900)]),
        "events": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", [(k, dt.datetime(2024, 1, 1), r.randint(1, 9), r.choice(["click", "view", "buy"]), 1.0, "{}") for k in range(400)]),
        "documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT", [(k, "some text", r.choice(["en", "de", "fr"]), f"src{k % 3}", 9) for k in range(120)]),
        "labels": ("doc_id BIGINT, quality INTEGER, toxic INTEGER", [(k, r.randint(0, 1), 0) for k in range(0, 120, 3)]),
    }
    for name, (columns, values) in rows.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
        con.execute(f"COPY {name} TO '{d}/{name}.parquet' (FORMAT parquet)")
    return con, str(d)


def plain(rows):
    value = lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, name):
    con, sf_dir = tables
    frame = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    wanted = con.sql(catalog.SQL[name])
    assert columns == sorted(wanted.columns)
    assert plain(frame.select(columns).collect()) == plain(wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_names_all_queries():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_identity(spark, tables):
    """Rounds of draws, one after the other."""
    con, sf_dir = tables
    rows = con.sql("SELECT CAST(s_suppkey AS VARCHAR), s_nationkey FROM supplier ORDER BY s_suppkey").fetchall()
    wanted = {k: ("K" + k, "ledger") for k, nation in rows if nation < 12}
    taken, left = {v for v, _ in wanted.values()}, [k for k, nation in rows if nation >= 12]
    for attempt in range(100):
        drawn = {}
        for k in left:
            v = f"{int(hashlib.md5(f'42|dbo.supplier|i1|{k}|1|{attempt}'.encode()).hexdigest()[:8], 16) % 100000:05}"
            if v not in taken:
                drawn[v] = min(k, drawn.get(v, k))
        wanted |= {k: (v, "minted") for v, k in drawn.items()}
        taken |= set(drawn)
        left = [k for k in left if k not in wanted]
    got = catalog.QUERIES["plan_identity"](spark, sf_dir).collect()
    assert len(got) == len(rows) and {r["key"]: (r["value"], r["origin"]) for r in got} == wanted
