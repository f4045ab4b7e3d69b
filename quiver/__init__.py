"""quiver: a PySpark-native engine for retrieval data.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``sources``    – table loaders, derived test views, parameterised SQL, CSV, sinks
* ``functions``  – column functions (vector math on Arrow batches, text, dates, JSON, templates)
* ``operators``  – labelling, points, kNN/ANN, quantization, statistics,
                   enrichment rules, sessions, collections
* ``plans``      – composed jobs (load job, batch evaluation, retrieval)
* ``streaming``  – Structured Streaming twins of the incremental operators
"""

from quiver.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
