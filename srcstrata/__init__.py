"""srcstrata: source-repository analytics as Spark jobs.

Files, lines, classes and methods are extracted from source trees; the
catalogue of repositories, branches, commits, scans and daily metrics is kept
by pure ``DataFrame -> DataFrame`` operators and answered by Spark queries.
"""
