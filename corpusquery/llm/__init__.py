"""Operators of a training-data pipeline over the tables documents, labels, benchmark and conversations.

Nothing outside this subpackage imports it; ``registry`` collects the queries and their SQL.
"""
