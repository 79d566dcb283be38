"""Evidence-grounded analysis of text archives on Spark."""
