"""Delivery-zone planning and corpus preparation on PySpark."""
