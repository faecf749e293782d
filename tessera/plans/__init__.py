"""Query plans over the driver tables (registered in ``__spark_entry__``)."""
