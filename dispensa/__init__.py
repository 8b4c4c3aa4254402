"""dispensa — pharmacy operations analytics and batch posting on Spark.

Reports, admission checks, posting and dimension maintenance expressed as
DataFrame / SQL plans.  Every operator takes DataFrames and returns
DataFrames; nothing is collected to the driver in the core.
"""

__all__ = ["model", "session"]
