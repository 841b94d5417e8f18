"""Rule-driven detection, correlation and log analytics expressed as Spark DataFrame plans."""
