"""The workload's queries, composed from the operators."""
