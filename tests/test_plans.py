"""What the optimizer makes of the queries: no joins of all pairs, filters in the scan, one exchange where one is enough."""

import re

import pytest

from vesperflow.plans import registry

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in registry.QUERIES if n.endswith("_stream")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMS))
def test_no_query_joins_all_pairs(spark, name):
    assert not re.search("NestedLoop|Cartesian", plan(registry.QUERIES[name](spark, SF)))


def test_stored_pixels_prune_the_scan(spark):
    p = plan(registry.QUERIES["healpix_cover_semijoin"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*In\(hpx", p) and "ra" in p


@pytest.mark.parametrize(("name", "most"), [("convolve_3x3", 2), ("asof_latest_order", 1), ("stack_sum_avg_weighted", 1), ("unwrap_phase", 1), ("sliding_regression_min", 4), ("resample_linear", 2)])
def test_exchanges_are_few(spark, name, most):
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan(registry.QUERIES[name](spark, SF)))) <= most


def test_scans_read_only_what_is_used(spark):
    p = plan(registry.QUERIES["stack_median"](spark, SF))
    assert "l_shipdate" not in p.split("ReadSchema")[1] and "l_tax" not in p.split("ReadSchema")[1]


def test_tiles_prune_the_folders(spark):
    p = plan(registry.QUERIES["tile_pruned_scan"](spark, SF))
    assert re.search(r"PartitionFilters: \[[^\]]*tile", p)


@pytest.mark.parametrize("name", ["asof_linear_interp", "path_history"])
def test_brackets_take_one_exchange(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(_k", p)) == 1
