"""Compositions of operators: processing, detection, tuning; and the registered queries."""
