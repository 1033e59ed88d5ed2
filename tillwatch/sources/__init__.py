"""Inputs and outputs of a run."""
