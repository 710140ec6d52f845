"""Independent SQL for comparing results, and awkward copies of the test extracts."""
