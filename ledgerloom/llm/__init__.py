"""Operators for training data and free text. Nothing outside this folder imports it."""
