"""Operational log analytics as Spark jobs.

``functions``  column expressions, all JVM side
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers, writers and table maintenance
``plans``      registered queries over the test tables, each with its SQL twin
``streaming``  Structured Streaming forms of the incremental operators
"""
