"""From definitions to DataFrames: provenance, the store, and the evaluation of requests."""
