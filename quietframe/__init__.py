"""quietframe: spectral analysis and noise reduction of sampled signals on Spark."""

__version__ = "0.1.0"
