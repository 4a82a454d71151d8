"""The registered queries: coverage of the inventory, and a sample against DuckDB at the smallest scale."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
INVENTORY = ([f"S{i}" for i in range(1, 8)] + [f"P{i}" for i in range(1, 55)] + [f"A{i}" for i in range(1, 21)] + [f"H{i}" for i in range(1, 37)] + [f"J{i}" for i in range(1, 19)] + [f"L{i}" for i in range(1, 12)]
             + [f"G{i}" for i in range(1, 22)] + [f"I{i}" for i in range(1, 15)] + ["C1", "C2", "C4", "C5", "C6"] + [f"V{i}" for i in range(1, 23)] + [f"F{i}" for i in range(1, 18)] + [f"T{i}" for i in range(1, 8)] + ["U1", "U2", "U3"])


def test_every_row_of_the_inventory_is_registered():
    have = {k.split("_")[0] for k in entry.queries()}
    assert [i for i in INVENTORY if i not in have] == []
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", ["P1_statement_split", "P25_local_references_dropped", "A2_complexity", "H24_leading_wildcard", "J9_file_graph", "L5_statement_edges", "C4_corpus_diff"])
def test_sample_against_duckdb(spark, key):
    duck = duckdb.connect()
    for t in ("orders", "customer", "supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[key](spark, SF)
    res = duck.execute(entry.oracle_sql()[key])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))


def test_sources_never_checkpoint_locally():
    import pathlib
    root = pathlib.Path(entry.__file__).parent
    for f in [*root.glob("sqlstrata/**/*.py"), *root.glob("suite/*.py")]:
        assert not re.search(r"localCheckpoint|crossJoin", f.read_text()), f
