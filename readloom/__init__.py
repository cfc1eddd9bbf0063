"""readloom: sequence-read analytics as Spark DataFrames."""
