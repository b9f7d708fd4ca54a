"""Retrieval, audit, log, publication and evaluation operators over DataFrames."""
