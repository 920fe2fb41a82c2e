"""Files of settled steps that nothing reads again are deleted."""

import os

from tickloom.llm.common import shared_folder
from tickloom.llm.simhash import components


def test_components_leave_two_rounds_at_most(spark):
    folder = shared_folder(spark).removeprefix("file:")
    rdds = lambda: {d for _, ds, _ in os.walk(folder) for d in ds if d.startswith("rdd-")}
    before = rdds()
    found = components(spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)}
    assert len(rdds() - before) <= 2
