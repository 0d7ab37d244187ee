"""Part of the pair-matching engine."""
