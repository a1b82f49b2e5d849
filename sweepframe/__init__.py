"""Spatio-temporal LiDAR analytics as Spark DataFrame programs."""
