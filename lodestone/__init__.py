"""lodestone: code and history analytics expressed as Spark DataFrame plans."""
