"""Catalogue analytics and data-quality operators for Spark."""
