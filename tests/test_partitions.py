"""The rows of a query do not depend on how its input is partitioned or ordered."""

from __future__ import annotations

import oracle
import pytest

from labelproof.plans import all_queries
from labelproof.schemas import INPUT_TABLES, Tables

ORDER_SENSITIVE = (
    "d6_suspicious_links_8_bits",
    "e15_confusion_matrix",
    "e23_confidence_summary",
    "f1_rank_in_target",
    "f2_first_n_per_target",
    "f4_average_percent_rank",
    "f7_representative_rows",
    "f8_accept_cap",
    "f9_first_accepted_wins",
    "f11_early_stop",
    "g7_representative_mistakes",
    "h2_distinct_first_kept",
    "i1_ratio_split",
    "i2_quota_selected",
    "i4_group_sample",
    "i6_item_grid",
)


class Repartitioned(Tables):
    def __init__(self, spark, folder, partitions):
        super().__init__(spark, folder)
        self.partitions = partitions

    def __getattr__(self, name):
        frame = super().__getattr__(name)
        # a random order as well as another number of partitions
        return frame.repartition(self.partitions) if name in INPUT_TABLES else frame


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_same_rows(name, spark, folder):
    build = all_queries()[name].build
    results = []
    for partitions in (1, 17):
        frame = build(Repartitioned(spark, folder, partitions))
        results.append(oracle.canonical(frame.columns, [tuple(r) for r in frame.collect()]))
    assert results[0] == results[1]
