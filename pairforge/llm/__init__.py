"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns DataFrames, reads only the columns it names and
ignores others, and works over whole tables and whole texts. ``queries`` registers one query
per operator; nothing outside this folder imports it but the guarded entry point.

Tasks import this package, so executors need it on their Python path (``--py-files``)."""
