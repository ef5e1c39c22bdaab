"""Numpy routines for one group at a time: geometry, paths, clustering, tours and search. No Spark in here."""
