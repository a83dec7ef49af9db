"""Auction-stream analytics as Spark DataFrame operators, batch and streaming."""
