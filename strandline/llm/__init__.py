"""Training-data operators: one module for each operator, and their registered queries in ``queries``."""
