"""Text reconciliation on Spark: segmentation, lookup, retrieval, verification and coverage."""
