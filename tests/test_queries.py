import importlib.util
import os

import pytest
from conftest import SMALL, same_as_sql

from dialoom.plans import bundles, evaluation, problems, reference, repairs

PARTS = [problems, reference, repairs, evaluation, bundles]
#: Queries that may have no rows on the smallest data.
MAY_BE_EMPTY = {"unit_violations", "item_ids_taken_twice", "closure_repeats", "repeated_wording", "item_id_collisions", "config_violations", "session_first_context", "whole_units", "index_gaps", "mojibake_repaired", "compatibility_forms", "schema_violations", "evidence_overlap"}
NAMES = [(part, name) for part in PARTS for name in part.ORACLE_SQL]
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@needs_data
@pytest.mark.parametrize(("part", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query_equals_sql(spark, duck, part, name):
    mine, theirs = same_as_sql(spark, duck, part, name)
    assert mine == theirs and (mine or name in MAY_BE_EMPTY)


def test_names_are_unique():
    names = [n for part in PARTS for n in part.QUERIES]
    assert len(names) == len(set(names))


def test_the_entry_lists_every_query():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert {n for part in PARTS for n in part.QUERIES} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
