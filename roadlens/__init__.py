"""roadlens: traffic-incident analytics as Spark DataFrame and Structured Streaming jobs.

Every operator takes and returns DataFrames.  Nothing is collected to the driver
except fitted statistics whose size is bounded by a parameter (a handful of
coefficients, a fixed list of categories), and those go back out as literals or
broadcast rows of checked size.
"""

__all__ = ["session", "adapters", "config"]
