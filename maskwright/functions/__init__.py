"""Part of the text anonymisation engine."""
