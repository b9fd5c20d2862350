"""Emergency-response analytics on Spark: parameterised reports over dispatch extracts.

Typical use::

    from ersa import load_dispatch_csv, counts, times, erf, concurrency
    rows, rejects = load_dispatch_csv(spark, "/data/cad/extract-*.csv")
    counts.district_scorecard(rows, Window(start, end))
    times.time_stat_report(rows, times.TIME_SPECS["r13_travel_urban_fire_v2024"])
    erf.erf_report(rows, erf.ERF_SPECS["r19_erf_commercial_urban_v2025"])
    concurrency.concurrent_events(rows)
"""

from ersa.plans import concurrency, counts, erf, times  # noqa: F401
from ersa.schema import ErfSpec, TimeStatSpec, Window  # noqa: F401
from ersa.sources.csv_ingest import ingest_csv, load_dispatch_csv, quality_counts  # noqa: F401
from ersa.sources.tables import district_extract, normalise, staffing, write_bucketed_table  # noqa: F401
