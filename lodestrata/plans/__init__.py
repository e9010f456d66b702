"""Runs: one configuration in, one result out."""
