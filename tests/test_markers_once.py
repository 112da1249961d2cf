"""The marker's many lookups ask where rides are once."""

from __future__ import annotations

import pyarrow as pa
import pytest

from paceline.streaming import tracking


def test_markers_ask_places_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema)

    rows = [(1, k, 0, 25.0 * k, 25.0 * k, True, 20.0) for k in range(50)]
    kind = "ride_id long, seq int, route_id long, place_m double, odo_m double, reliable boolean, lead_s double"
    curve = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 10_000.0, 2_000.0)], "route_id long, k int, distance_m double, time_s double")
    got = tracking.markers(spark.createDataFrame(rows, kind).mapInArrow(counted, kind), curve).collect()
    assert [r["marker_m"] for r in sorted(got, key=lambda r: r["seq"])] == pytest.approx([max(0.0, 25.0 * k - 100) for k in range(50)])
    assert asked.value == 50
