"""Support-reply analytics expressed as Spark DataFrame transformations."""
