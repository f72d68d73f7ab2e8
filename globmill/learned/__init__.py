"""Learned cardinality estimators in numpy: trained on the driver from bounded samples, applied by Arrow batches."""
