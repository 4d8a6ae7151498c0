"""Compositions of operators: the panel, the prediction runs, the risk report and the query registry."""
