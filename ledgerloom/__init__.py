"""Claim analytics on Spark: DataFrame-first operators over claims, relations and documents."""
