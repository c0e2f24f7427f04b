"""Retail demand analytics as Spark jobs: star schema, features, quantiles, orders, replay."""
