"""tablelens — table profiling, cleaning, quality gating and insight
operators as lazy Spark DataFrame plans."""

__version__ = "0.1.0"
