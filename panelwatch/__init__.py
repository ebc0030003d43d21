"""Early-warning analytics for entity-by-month panels, written as Spark DataFrame operators."""
