"""panelcast: panel analytics and projection as Spark DataFrame operators.

A *panel* is a table of entities (``state``, ``place``) observed over an integer
time axis (``year``).  Two shapes are used, each where Spark is cheapest:

* **wide** - one row per entity and time, one column per measure.  Row-wise work
  (cleaning, percent to count, sums, ratios) is a projection here: no shuffle.
* **long** - ``(state, place, year, metric, value)``.  Per-measure work (lags,
  scaling, quantiles, errors) is one window or one aggregate here.

``operators.shape.to_long`` turns wide into long without losing the entity
partitioning, so a whole preparation run costs one shuffle by entity.
"""

__version__ = "0.1.0"
