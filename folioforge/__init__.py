"""folioforge: document search and text analytics as Spark DataFrame plans."""
