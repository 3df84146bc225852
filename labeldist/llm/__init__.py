"""Operators for training-data pipelines (see README, section "Training-data operators")."""
