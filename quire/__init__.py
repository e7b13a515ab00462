"""quire: a Spark-native pipeline for academic-paper metadata.

Raw source responses are normalised to one paper schema, deduplicated within a
run and against a ledger of known keys, gated, written as CSV drops, loaded
with cleaning and typing into a paper table with a per-file load log, and
queried (listings with totals, distinct sites, lookups, history, statistics).
Every step is a DataFrame plan; see README.md for the module map.
"""

__version__ = "0.1.0"
