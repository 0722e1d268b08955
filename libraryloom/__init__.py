"""Document-library analytics on Spark: curated records, audits, matching, lifecycle and intake as DataFrame plans."""
