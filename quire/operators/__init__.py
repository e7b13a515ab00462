"""Table jobs of the pipeline: harvest, dedup, cleaning, numbering, queries."""
