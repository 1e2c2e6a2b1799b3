"""Spark operators for classified-listing valuation.

Every operator is a function from DataFrame to DataFrame over built-in Spark SQL,
Structured Streaming and MLlib expressions; there is no Python UDF.
"""
