"""Registered queries against their oracles; `python -m tests.compare <sf_dir>` runs all of them."""

import os

import pytest

from workload.oracles import ORACLES
from workload.queries import QUERIES

from .compare import compare, connect

SF = "/root/testdata/sf0.001"
# Those that take a second or less; the others have unit tests next to their operators.
QUICK = ["json_validity", "status_screen", "error_snippets", "envelope_detect", "envelope_unwrap", "value_kinds", "iso_kinds",
         "source_connectivity", "path_violations", "first_violations", "url_join", "link_scope", "quarantine", "ts_join_collapse",
         "ts_relate_orphans", "ts_extend", "ts_split", "ts_merge", "enum_parse", "enum_unmatched", "variant_tag", "union_conform",
         "typed_load", "schema_diff"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    assert compare(spark, connect(SF), SF, name) is None
