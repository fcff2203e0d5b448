"""maskwright: profiling and redaction of personal data over Spark DataFrames."""
