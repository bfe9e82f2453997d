"""parcelry: order-message intake and order analytics on Spark.

Raw order messages are decoded strictly against a fixed nested schema,
checked against field and storage rules, routed to exactly one outcome
(stored, dead letter with a reason, discarded as undecodable), de-duplicated
by order uid and stored as one nested row per order.  Normalised order,
delivery, payment and item tables are projections of that row; order
documents, flat views, latest-N snapshots and the operational series
(outcome rates, dead-letter reasons, latency histograms and quantiles,
consumer lag, hit rates) are DataFrame queries over it.

Sub-packages:

* ``sources``   - table loaders, message envelopes, file/array sources.
* ``functions`` - Column-level building blocks (decode, rules, paths, sizes).
* ``operators`` - DataFrame operators (documents, outcomes, series, ...).
* ``plans``     - plan helpers (guarded broadcast, lineage cuts) and the
                  query catalog used by ``__spark_entry__``.
* ``streaming`` - Structured Streaming jobs (intake, windowed rates).
"""

__version__ = "0.1.0"
