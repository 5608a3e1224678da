"""Spark-native structural analysis of C# source trees, and general data operators."""
