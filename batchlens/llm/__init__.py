"""Operators that prepare text corpora for language-model training.

Each module holds one operator: a DataFrame of documents (``doc_id``, ``text``,
any further columns) goes in, a DataFrame comes out.  Nothing outside this
folder imports it.  Work that Spark has no expression for runs in Arrow batches
inside tasks; only tables with a bound that does not depend on the number of
documents (plans, models, templates, histograms) reach the driver.
"""
