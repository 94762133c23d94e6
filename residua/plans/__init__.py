"""Compositions of operators: views, pipeline, reports, registered queries."""
