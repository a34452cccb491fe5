"""Ocean microstructure analytics on Spark: from raw counts to gridded dissipation."""

__version__ = "0.1.0"
