"""Evidence analytics on Spark: packages, rules, findings, judgements and text, as DataFrames."""
