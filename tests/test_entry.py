import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import database, differs

SMALL = "/root/testdata/sf0.001"
PICKED = ["a1_pair_day_relation", "a6_source_diversity", "a15_slice_totals", "j1_resolve_entities", "j6_build_panel", "p11_dedupe_events", "w2_decay_sum", "w3_seasonal_z", "w6_winsorize", "i7_bilateral_tension", "v5_metrics_cls", "v8_placebo", "v10_bh_fdr", "v11_robustness_grid", "v16_hypothesis_tree", "x8_search_evidence", "q11_no_future", "r3_stream_sliding"]


def test_entry_has_rows(spark):
    assert 0 < entry.entry(spark).count() <= 50


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_its_twin(spark, name):
    ours = entry.queries()[name](spark, SMALL).toPandas()
    assert not differs(ours, database(SMALL).sql(entry.oracle_sql()[name]).df())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in root.iterdir():
        if p.name in ("presslens", "__spark_entry__.py"):
            (tmp_path / p.name).mkdir() if p.is_dir() else (tmp_path / p.name).symlink_to(p)
    for p in (root / "presslens").iterdir():
        if p.name != "llm":
            (tmp_path / "presslens" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert 'a1_pair_day_relation' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
