"""tabweave: semantic measures and ETL dataflows as Spark DataFrame operators."""
