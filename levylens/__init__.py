"""Income-tax and taxable-sales analytics as plain Spark DataFrame transformations."""
