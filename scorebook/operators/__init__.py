"""Filters, joins, ordering, projections, graphs and derivations over DataFrames."""
