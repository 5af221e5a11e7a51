"""Cloud-bill and data-platform review as plain Spark DataFrame transformations."""

__version__ = "0.1.0"
