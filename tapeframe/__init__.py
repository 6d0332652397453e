"""End-of-day equity analytics as composable PySpark DataFrame operators."""
