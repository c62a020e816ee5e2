import re

import __spark_entry__ as entry
from tidewatch.plans import catalog


def test_entry_gives_one_row_of_detection_metrics(spark):
    row = entry.entry(spark).first()
    total = row.true_positives + row.true_negatives + row.false_positives + row.false_negatives
    assert total > 0 and 0 <= row.accuracy <= 1


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_query_names_are_plain():
    assert not [n for n in catalog.QUERIES if "pipeline" in n or re.match(r"op\d", n)]


def test_fixed_values_are_complete():
    from tidewatch import fixed_values as fixed

    assert len(fixed.NSL_KDD_COLUMNS) == 43 and len(set(fixed.NSL_KDD_COLUMNS)) == 43
    assert len(fixed.label_to_category(fixed.CICIDS_CATEGORIES)) == 15
    assert len(fixed.label_to_category(fixed.NSL_KDD_CATEGORIES)) == 40
    assert len(fixed.CICIDS_NOT_FEATURES) == 20
