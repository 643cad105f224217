"""Sources and sinks: documents of the domain as DataFrames, and back."""
