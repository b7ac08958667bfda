"""The driver's contract, and queries against their SQL."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from orbisplit.plans import catalogue

SF = "/root/testdata/sf0.001"
CHECKED = [
    "l2_normalize", "knn_self", "lid", "density_stats", "first_match_assign", "point_split", "adaptive_radius_lid", "cross_batch_dedup_class_aware",
    "snap_lid_weighted", "validate_candidates", "split_ratios", "heatmap_grid", "consensus_union", "fraction_sample", "path_strings",
    "knn_by_cells", "close_pairs_by_cells", "heatmap_filled", "center_positions", "aligned_batches", "sobol_points", "sphere_volume", "closed_loop_accept",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "documents", "pages", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({catalogue.SQL[name]})").fetchall()
    as_text = lambda rows: sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)
    assert as_text(map(tuple, got.select(*columns).collect())) == as_text(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["split", "n"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= len(catalogue.QUERIES)


def test_entry_without_the_training_data_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("orbisplit.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("orbisplit.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name=name)

    import orbisplit

    monkeypatch.delattr(orbisplit, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    importlib.invalidate_caches()
    assert set(entry.queries()) == set(catalogue.QUERIES)
