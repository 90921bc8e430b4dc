"""Operators of a training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it; ``queries.py`` lists the
registered queries.  Every operator reads only the columns it names
(``doc_id``, ``text``, ``source``, ``lang``), so further columns of any name
do no harm.
"""
