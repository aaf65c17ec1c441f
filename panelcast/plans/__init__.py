"""Composite plans: model training, end-to-end pipeline, cross-entity validation."""
