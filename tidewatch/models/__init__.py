"""Classifiers, ensembles and model selection."""
