"""vaxframe: immunization-registry analytics as PySpark DataFrame operators."""
