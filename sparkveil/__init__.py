"""Scanning of large text collections for leaked credentials and hidden Unicode, as Spark expressions."""
