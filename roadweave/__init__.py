"""roadweave: trajectory, interaction-graph and risk analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
