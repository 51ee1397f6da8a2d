"""Review analytics on Spark DataFrames.

Layout
------
``schema``      table schemas and conforming casts
``functions``   column expressions (codes, text, dates, vectors, hashing)
``sources``     table readers and writers, page extraction
``operators``   filters, periods, neighbours, sampling, maintenance, requests
``plans``       the named reports, payloads, ad-hoc SQL and request actions
``streaming``   continuous ingest, de-duplication and rating series
"""
