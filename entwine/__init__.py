"""entwine: entity reconciliation and the analytics around it, as Spark DataFrame plans."""

__version__ = "0.1.0"
