"""Inputs and outputs: declared-schema scans, fixture adapters, artifact sinks."""
