"""outlay: cloud-cost analytics as PySpark DataFrame operators."""
