"""The batch jobs, composed from the operators."""
