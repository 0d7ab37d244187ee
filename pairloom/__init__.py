"""Pair-matching analytics engine expressed as Spark DataFrame plans."""
