"""attrition: churn-style analytics as Spark DataFrame / MLlib jobs."""

__version__ = "0.1.0"
