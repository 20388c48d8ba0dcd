"""Spark-native curation, cleaning, anomaly scoring and explanation of wide batch tables.

Layers, lowest first:

* ``functions``  column expressions, no DataFrame in sight
* ``sources``    reading and writing tables, and the shared folder lineage is cut in
* ``operators``  DataFrame in, DataFrame out
* ``plans``      the chains a user runs end to end

Nothing here creates a session, and nothing but scalars, column names and
matrices whose size depends on the number of columns reaches the driver.
"""
