"""End-to-end jobs and report queries composed from the operators."""
