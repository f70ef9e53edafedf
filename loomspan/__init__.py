"""Text-reuse analytics expressed as Spark DataFrame plans."""
