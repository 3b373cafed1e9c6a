"""spindrift: declarative synthetic and semi-synthetic data on Spark."""
