"""Catalogues, planners and the query registry."""
