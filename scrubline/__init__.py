"""Text privacy analytics on Spark: span detection, masking, measurement and risk as DataFrame operators."""
