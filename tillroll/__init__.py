"""tillroll: purchase-history analytics as plain Spark DataFrame operators."""
