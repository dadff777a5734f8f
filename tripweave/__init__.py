"""Mobility and trajectory-graph analytics on Spark DataFrames.

Raw location check-ins become sites, trips, a weighted site-to-site graph,
ranks, communities and popular routes.  Every operator takes and returns
DataFrames.
"""
