"""fabspark — semiconductor yield analytics as plain Spark DataFrame functions.

Sub-packages:

* ``sources``   — table readers, derived fixtures, text/wafer ingest and data checks
* ``functions`` — Column-level helpers (labels, arrays, yield models, hashing)
* ``operators`` — DataFrame -> DataFrame operators (wafer windows, profiling,
  model fitting, preparation, splits, resampling, training, evaluation, scoring)
* ``plans``     — end-to-end flows and the query catalog used by the driver
* ``streaming`` — Structured Streaming variants of scoring and time-binned rates
* ``sinks``     — report, bundle and split writers
"""

__version__ = "0.1.0"
