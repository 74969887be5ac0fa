"""Evaluation of predicted per-pixel maps and corpus preparation, as Spark plans."""
