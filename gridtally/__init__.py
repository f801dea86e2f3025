"""Household meter-reading analytics as Spark jobs.

Readings come in as CSV, are cleaned and de-duplicated, rolled up per hour, day,
week, month and household, checked for three-sigma outliers and stored in warehouse
tables that the report functions query. Every function takes and returns DataFrames.
"""
