"""Versioned evaluation results on Spark: filters, projections, graphs and derivations as DataFrame plans."""
