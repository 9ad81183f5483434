"""Nested, jagged and waveform columns as Spark DataFrames."""
