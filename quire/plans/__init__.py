"""Composed runs (harvest, load) and the fixture views over the test tables."""
